"""Free-text tasks (L13-L15, M5, C6): answers are compared to the gold text with ROUGE and embedding match.

Everything works on pairs (keys..., pair_id, pred, ref) of whole texts. The in-row counters of a pair - n-gram overlaps,
the longest common subsequence and the two sides of the embedding match - are taken once; metrics, the scorer's training
labels and the text cascade only average them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import strip_head
from ..operators.embed_match import embed_match_pairs, pair_numbers_udf, shared_vectors
from ..operators.intervals import sums_on_grid
from ..operators.sampling import split_hash
from ..session import staged
from ..sources import prompts as P
from .cascade import accept_steps

DIGITS = 9
EXACT = "decimal(28,18)"  # of an F-measure that is summed as differences


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.turn_pairs(spark, sf_dir)
    return t.select("pair_id", F.col("assistant_text").alias("pred"), F.col("user_text").alias("ref"))


def answer_pairs(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """(prompt_id, tier, model, pred, ref): answers meet the length of their prompts, echo stripped, both sides lower-cased."""
    sizes = prompts.select("prompt_id", F.length("prompt_text").alias("n_chars"), "gold_text")
    rows = answers.select("prompt_id", "tier", "model", "response").join(sizes, "prompt_id")
    return rows.select("prompt_id", "tier", "model", F.lower(strip_head("response", "n_chars", "model")).alias("pred"), F.lower("gold_text").alias("ref"))


def _f(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def pair_scores(pairs: DataFrame, embeddings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., pair_id, rouge1, rouge2, rougeL, emb_p, emb_r, emb_f1, no_vector): F-measures of every pair, and how many of
    its tokens have no vector.

    All of them come from one pass over the texts, with a vector table of any size.
    """
    rows = pairs.select(*keys, "pair_id", pair_numbers_udf(shared_vectors(embeddings))(F.lower("pred"), F.lower("ref")).alias("c"))

    def overlap_f(part: Column, n: int) -> Column:
        return _f(_share(part, F.col(f"c.np{n}")), _share(part, F.col(f"c.nr{n}")))

    return rows.select(
        *keys, "pair_id", overlap_f(F.col("c.ov1"), 1).alias("rouge1"), overlap_f(F.col("c.ov2"), 2).alias("rouge2"), overlap_f(F.col("c.lcs"), 1).alias("rougeL"),
        F.col("c.p").alias("emb_p"), F.col("c.r").alias("emb_r"), _f(F.col("c.p"), F.col("c.r")).alias("emb_f1"), F.col("c.no_vector").alias("no_vector"),
    )


SCORES = ("rouge1", "rouge2", "rougeL", "emb_p", "emb_r", "emb_f1")


def _means(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), *[F.round(F.avg(c), DIGITS).alias(c) for c in SCORES], F.sum("no_vector").cast("bigint").alias("no_vector")
    )


def text_metrics(pairs: DataFrame, embeddings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: ROUGE-1 / 2 / L and embedding P / R / F1, means over pairs."""
    return _means(pair_scores(pairs, embeddings, keys), keys)


def scorer_labels_text(pairs: DataFrame, embeddings: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """M5: a training row is right (1) when its embedding-match F1 is above 0.8."""
    per = embed_match_pairs(pairs, embeddings, list(keys))
    return per.select(
        *keys, F.col("pair_id").alias("prompt_id"), F.round("f", DIGITS).alias("emb_f1"),
        (F.col("f") > F.lit(C.SCORER_LABEL_MIN_F1)).cast("int").alias("label"),
    )


def training_rows_text(prompts: DataFrame, answers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(model, tier, prompt_id, scorer_text, response, label, split) of a text task: the scorer reads the raw output (P7), and
    it is right (1) when its embedding-match F1 is above the limit (M5)."""
    pairs = answer_pairs(prompts, answers).select("model", F.col("prompt_id").alias("pair_id"), "pred", "ref")
    labels = scorer_labels_text(pairs, embeddings).select("model", "prompt_id", F.col("label").cast("double").alias("label"))
    rows = answers.select("model", "tier", "prompt_id", F.col("response").alias("scorer_text"), "response").join(labels, ["model", "prompt_id"])
    return split_hash(rows, C.VALIDATION_PCT["samsum"])


def cascade_text(
    prompts: DataFrame, answers: DataFrame, scores: DataFrame, embeddings: DataFrame, strategy: str = "strategy-9",
    thresholds: Sequence[float] | DataFrame = C.THRESHOLDS_SAMSUM,
) -> DataFrame:
    """Text cascade per threshold over stored answers and scores: the gate picks one answer per prompt, then
    ROUGE-1 / 2 / L and embedding P / R / F1 of the accepted answers.

    Every answer is compared with its gold text once; its numbers are summed over the thresholds at which its tier accepts
    (decimals, so that sums of differences are exact), and no text or row is copied per threshold. A prompt without an
    answer at its accepting tier counts with zero scores.
    """
    chain = C.CHAINS[C.STRATEGIES[strategy]]
    pairs = answer_pairs(prompts, answers.where(F.col("model").isin([t.model for t in chain]))).withColumnRenamed("prompt_id", "pair_id")
    per = staged(pair_scores(pairs.drop("model"), embeddings, ["tier"]), "answer-scores")
    gate = scores.where(F.col("strategy") == strategy).select(F.col("prompt_id").alias("pair_id"), "tier", "score")
    said = per.join(gate, ["pair_id", "tier"], "left").groupBy("pair_id").agg(F.collect_list(F.struct("tier", "score", *SCORES, "no_vector")).alias("said"))
    rows = prompts.select(F.col("prompt_id").alias("pair_id")).join(said, "pair_id", "left")

    def step(tier: Column) -> Column:
        own = F.get(F.filter("said", lambda x: x["tier"] == tier), F.lit(0))
        exact = (F.coalesce(own[c], F.lit(0.0)).cast(EXACT).alias(c) for c in SCORES)
        return F.struct(own["score"].alias("score"), own.isNotNull().alias("answered"), *exact, F.coalesce(own["no_vector"], F.lit(0)).cast("long").alias("no_vector"))

    steps = rows.select(F.transform(F.array(*(F.lit(t.tier) for t in chain)), step).alias("steps"))
    intervals = steps.select(F.explode(accept_steps("steps", (*SCORES, "no_vector"))).alias("a")).select("a.*")
    values = {"pairs": F.lit(1).cast("long"), **{c: F.col(c) for c in (*SCORES, "no_vector")}}
    sums = sums_on_grid(intervals.withColumn("strategy", F.lit(strategy)), ["strategy"], values, thresholds)
    mean = lambda c: F.round(F.col(c).cast("double") / F.col("pairs"), DIGITS).alias(c)
    return sums.select("strategy", "threshold", "pairs", *map(mean, SCORES), "no_vector")
