"""URL filter: host and path rules first, gradient-boosted trees on lexical features for what they leave open.

Labels come from a table (page_id, bad) where one is given. For other URLs the verdict of a rule is the label, and where no
rule decides a weak list: a host with a word of ``BAD_WORDS`` among its parts counts as bad, others as good. The trees
never see words or rules, only counts, ratios, entropies and suffix statistics, so they carry over to hosts that no list
names. They are fitted (Spark ML) on a bounded sample of ``max_train_rows`` URLs, lowest hash first.

Features are DataFrame functions. Suffix statistics are out of fold: hosts are dealt into folds, and the rate of bad URLs of
a suffix is counted over the other folds, so no URL meets its own label or that of its host. They are counted over all
URLs and come back by an equi-join on (suffix, fold). The trees of all folds but one, scored on that one, give the
held-out AUC that is reported.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiergate.llm.common import let, lower_az, stage

#: (verdict, host, path): the longest rule that fits a URL decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

BAD_WORDS = (
    "ads", "adult", "adserver", "banner", "bet", "bets", "betting", "bingo", "casino", "clickbait", "coupon", "escort",
    "farm", "gambling", "jackpot", "keygen", "lottery", "malware", "nude", "payday", "pharma", "phish", "pills", "poker",
    "popup", "porn", "replica", "sex", "slots", "spam", "torrent", "track", "tracker", "tracking", "viagra", "warez",
    "xxx",
)

MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
FOLDS = 5
THRESHOLD = 0.5
SMOOTHING = 10.0

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "host_parts", "path_depth", "n_params", "digit_ratio",
    "host_digit_ratio", "host_hyphens", "path_hyphens", "longest_part", "vowel_ratio", "host_entropy", "url_entropy",
    "secure", "has_port", "escapes", "suffix_share", "suffix_rate", "top_share", "top_rate",
)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" or for null."""
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://" or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host or a subdomain of it, and start of path, the URL has; else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in a regular expression's character class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("double")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""

    def of(t: Column) -> Column:
        n = F.length(t)
        share = lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n
        terms = F.transform(F.array_distinct(F.split(t, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
        return F.when(n == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))

    return let(text, of)


def is_bad(host: Column) -> Column:
    """The label: some part of the host, between dots and hyphens, is on the word list."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, BAD_WORDS)))


def parsed(pages: DataFrame, url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, suffix, top, fold, bad): ``suffix`` is the host's last two parts, ``top`` its
    last; ``bad`` is the label.

    ``labels``: (page_id, bad); of an id with several labels bad wins, ids and labels that are null are left out.
    """
    text = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select("page_id", text.alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("decided", rule_of(F.col("host"), F.col("path")))
    given = F.lit(None).cast("boolean")
    if labels is not None:
        known = labels.select(F.col("page_id").alias("__id"), F.col("bad").cast("boolean").alias("given")).where("__id IS NOT NULL AND given IS NOT NULL")
        rows = rows.join(known.groupBy("__id").agg(F.max("given").alias("given")), F.col("page_id") == F.col("__id"), "left").drop("__id")
        given = F.col("given")
    name = F.regexp_replace("host", ":[0-9]*$", "")
    return rows.select(
        "page_id", "url", "host", "path", "decided.rule", "decided.verdict",
        F.substring_index(name, ".", -2).alias("suffix"), F.substring_index(name, ".", -1).alias("top"),
        F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
        F.coalesce(given, F.col("decided.verdict") == "block", is_bad(F.col("host"))).alias("bad"),
    )


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1))
    longest = F.array_max(F.transform(F.split(host, r"\."), lambda p: F.length(p)))
    values = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "host_parts": _count(host, ".") + 1, "path_depth": _count(path, "/"),
        "n_params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "digit_ratio": _count(url, "0-9") / size, "host_digit_ratio": _count(host, "0-9") / F.greatest(F.length(host), F.lit(1)),
        "host_hyphens": _count(host, "-"), "path_hyphens": _count(path, "_-"), "longest_part": longest,
        "vowel_ratio": _count(host, "aeiouy") / F.greatest(F.length(host), F.lit(1)),
        "host_entropy": entropy(host), "url_entropy": entropy(url),
        "secure": url.startswith("https:"), "has_port": host.rlike(":[0-9]+$"), "escapes": _count(url, "%"),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()})


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """Add, for the host's last two parts and its last part, the log share of all URLs, and the smoothed rate of bad ones
    among the URLs of the other folds. Both tables grow with the number of suffixes, so they are joined."""
    n, bad = rows.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    mean = float(bad or 0.0)
    for key, name in (("suffix", "suffix"), ("top", "top")):
        table = rows.groupBy(key, "fold").agg(F.count("*").alias("k"), F.sum(F.col("bad").cast("long")).alias("b"))
        all_folds = Window.partitionBy(key)
        k, b = F.sum("k").over(all_folds), F.sum("b").over(all_folds)
        rate = (b - F.col("b") + SMOOTHING * mean) / (k - F.col("k") + SMOOTHING)
        table = table.select(F.col(key).alias("__key"), F.col("fold").alias("__fold"), F.log(k / F.lit(n)).alias(f"{name}_share"), rate.alias(f"{name}_rate"))
        rows = rows.join(table, (F.col(key) == F.col("__key")) & (F.col("fold") == F.col("__fold"))).drop("__key", "__fold")
    return rows


def _trees(sample: DataFrame):
    """Fitted trees, or the one label of a sample with less than two."""
    classes = [r["label"] for r in sample.select("label").distinct().collect()]  # at most two rows
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(sample) if len(classes) == 2 else classes[0] if classes else 0.0


def scored(rows: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Add ``score``, the trees' probability that a URL is bad (with labels of one class only, that class's 0 or 1), and
    ``held_out_auc``: the area under the curve of trees fitted on the sample without fold 0, on the sample's fold 0 (null if
    either has labels of one class only)."""
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    sample = ready.select("features", F.col("bad").cast("double").alias("label"), "fold", "url", "page_id")
    sample = sample.orderBy(F.xxhash64("url"), "url", "page_id").limit(max_train_rows).select("features", "label", "fold")
    sample = stage(sample, "url-sample")
    rest, held = _trees(sample.filter("fold <> 0")), sample.filter("fold = 0")
    auc = None
    if not isinstance(rest, float) and held.select("label").distinct().count() == 2:
        auc = BinaryClassificationEvaluator().evaluate(rest.transform(held))
    model = _trees(sample)
    rows = rows if isinstance(model, float) else model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    score = F.lit(model) if isinstance(model, float) else F.col("score")
    return rows.withColumns({"score": score, "held_out_auc": F.lit(auc).cast("double")}).drop("features", "rawPrediction", "probability", "prediction")


def judge(
    pages: DataFrame, labels: DataFrame | None = None, url: str = "url", max_train_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, held_out_auc) for every row of ``pages``, repeated rows included.

    ``verdict`` is the rule's, or "block" where the score reaches ``threshold``, else "allow". A null URL, or one
    without "://", has empty host and path, no rule, and is scored like any other. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = stage(with_suffix_statistics(lexical(stage(parsed(pages, url, labels), "urls"))), "url-features")
    verdict = F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored(rows, max_train_rows).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "held_out_auc")
