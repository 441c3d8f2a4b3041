"""The whole cascade as a stream (C1 / T2): a prompt waits in keyed state at its tier until answer and score are there.

Two streams come in, in any order: answers ``(prompt_id, model, prompt_text, response, ts)`` of the models and scores
``(strategy, prompt_id, tier, score, ts)`` of the strategies' scorers. An answer is stripped and labelled as in the batch
job, sent to each strategy whose chain has its model, and meets its score in the state of its prompt's bucket:

* the state holds, for each prompt and strategy, the tier and what has come in for later tiers; of a repeated answer or score the first counts;
* a score above the threshold accepts, another one (null and NaN too) escalates, and the last tier accepts its answer
  without waiting for a score;
* a step that is not complete ``timeout`` after the prompt came to its tier is given up: an event-time timer escalates the
  prompt, and at the last tier accepts it without a label, as the batch cascade does for answers that it does not have;
* an accepted prompt stays known for ``timeout`` (so that a late copy is not a new prompt); then its state is dropped.

State therefore lives for at most (tiers + 1) x ``timeout`` of event time, and rows behind the watermark are dropped. Rows
without a prompt, strategy or tier take no part but move the watermark: a source that falls silent sends them as heartbeat.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..functions.rules import CASCADE_RULES
from ..functions.text import strip_echo
from ..session import scratch_path

ANSWERS = "prompt_id long, model string, prompt_text string, response string, ts timestamp"
SCORES = "strategy string, prompt_id long, tier int, score double, ts timestamp"
ACCEPTED = "strategy string, prompt_id long, tier int, pred int, score double, waited boolean"
#: Hundreds of waiting prompts a value at a million of them; more for longer queues.
BUCKETS = 4096
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate:
    """State of a bucket of prompts. For each (prompt, strategy): ``tier``, since when (``at``, ms) and until when (``due``),
    answers and scores by tier, whether accepted. A call and a state value per prompt cost milliseconds each, so prompts
    share them by a hash of their id; the timer of a bucket is set to the earliest ``due``."""

    def __init__(self, n_tiers: dict[str, int], threshold: float, timeout_ms: int):
        self.n_tiers, self.threshold, self.timeout_ms = n_tiers, threshold, timeout_ms

    def _step(self, key: str, s: dict, now: int, expired: bool) -> list[tuple]:
        """Move a prompt on as far as what is known allows; the accepted row, if it comes to that."""
        prompt_id, strategy = key.split(" ", 1)
        last, out = self.n_tiers[strategy], []
        while not s["done"]:
            k = str(s["tier"])
            known, score = k in s["answers"], s["scores"].get(k)
            complete = known and (s["tier"] == last or k in s["scores"])
            if not complete and not expired:
                break
            # a step without an answer offers no score, whatever the scorer said
            if s["tier"] == last or (known and score is not None and score > self.threshold):
                s["done"], s["at"] = True, now
                out = [(strategy, int(prompt_id), s["tier"], s["answers"].get(k), None if s["tier"] == last else score, expired and not complete)]
            else:
                s["tier"], s["at"], expired = s["tier"] + 1, now, False
        s["due"] = s["at"] + self.timeout_ms
        return out

    def __call__(self, key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = json.loads(state.get[0]) if state.exists else {}
        out, latest = [], {}
        for part in rows:
            for prompt_id, strategy, tier, kind, pred, score, ts in zip(*(part[c].tolist() for c in ("prompt_id", "strategy", "tier", "kind", "pred", "score", "ms"))):
                k = f"{prompt_id} {strategy}"
                s = known.get(k) or known.setdefault(k, {"tier": 1, "at": ts, "answers": {}, "scores": {}, "done": False})
                if kind == "answer":
                    s["answers"].setdefault(str(tier), None if pd.isna(pred) else int(pred))
                else:
                    s["scores"].setdefault(str(tier), None if pd.isna(score) else score)
                latest[k] = max(latest.get(k, 0), ts)
        for k, now in latest.items():
            if not known[k]["done"]:
                out += self._step(k, known[k], now, False)
        for k in [k for k, s in known.items() if s["due"] <= watermark]:  # one step a micro-batch: what came in with the next one counts first
            if known[k]["done"]:
                del known[k]
            else:
                out += self._step(k, known[k], known[k]["due"], True)
        if known:
            state.update((json.dumps(known),))
            state.setTimeoutTimestamp(max(min(s["due"] for s in known.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["strategy", "prompt_id", "tier", "pred", "score", "waited"])


@contextmanager
def _state_store(spark: SparkSession):
    """State that need not fit in memory: the RocksDB state store; the session's own choice comes back afterwards."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def events(answers: DataFrame, scores: DataFrame, dataset: str, strategies: Sequence[str]) -> DataFrame:
    """(strategy, prompt_id, tier, kind, pred, score, ts): labelled answers for each strategy that uses their model, and scores."""
    uses = [(s, t) for s in strategies for t in C.CHAINS[C.STRATEGIES[s]]]
    chains = F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(t.tier).alias("tier"), F.lit(t.model).alias("m")) for s, t in uses))
    pred = CASCADE_RULES[dataset](strip_echo("response", "prompt_text", "model"), F.col("model")).cast("int")
    said = answers.select("prompt_id", "model", pred.alias("pred"), "ts", F.explode(chains).alias("u")).where(F.col("u.m") == F.col("model"))
    said = said.select("u.strategy", "prompt_id", "u.tier", F.lit("answer").alias("kind"), "pred", F.lit(None).cast("double").alias("score"), "ts")
    rated = scores.where(F.col("strategy").isin(list(strategies)))
    rated = rated.select("strategy", "prompt_id", "tier", F.lit("score").alias("kind"), F.lit(None).cast("int").alias("pred"), "score", "ts")
    return said.unionByName(rated)


def stream_cascade(
    spark: SparkSession, answers: str, scores: str, out: str, checkpoint: str, threshold: float, dataset: str = "boolq",
    strategies: Sequence[str] = tuple(C.STRATEGIES), delay: str = "1 hour", timeout_hours: float = 24, files_per_trigger: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Drain the Parquet folders ``answers`` and ``scores`` into the accepted rows under ``out``, which are returned.

    A later call with the same ``checkpoint`` goes on where this one stopped. ``delay``: how late a row may be. ``buckets``: state
    values that the waiting prompts are spread over; a checkpoint keeps the number that it began with.
    """
    limit = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {}
    read = lambda schema, path: spark.readStream.schema(schema).options(**limit).parquet(path)
    rows = events(read(ANSWERS, answers), read(SCORES, scores), dataset, strategies)
    # one condition that names the event time, so that it stays behind the watermark, which heartbeat rows move
    named = F.col("strategy").isNotNull() & F.col("prompt_id").isNotNull() & F.col("tier").isNotNull()
    rows = rows.withWatermark("ts", delay).where(F.when(F.col("ts").isNull(), F.lit(False)).otherwise(named)).withColumn("ms", F.unix_millis("ts"))
    gate = Gate({s: len(C.CHAINS[C.STRATEGIES[s]]) for s in strategies}, float(threshold), int(timeout_hours * 3_600_000))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("prompt_id"), F.lit(buckets)))
    accepted = rows.groupBy("bucket").applyInPandasWithState(gate.__call__, ACCEPTED, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    with _state_store(spark):
        writer = accepted.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ACCEPTED).parquet(out)


def new_stream(spark: SparkSession) -> tuple[str, str]:
    """Folders for the result and the checkpoint of a new stream."""
    run = uuid.uuid4().hex
    return scratch_path(spark, "stream_cascade", run, "out"), scratch_path(spark, "stream_cascade", run, "ckpt")
