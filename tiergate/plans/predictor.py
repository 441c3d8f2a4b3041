"""Neural scorers as a plug-in of the gate (M2): batches through ``predict_batch_udf``.

``make_model`` builds (or loads) a model and returns a function from an array of texts to an array of class-1
probabilities. ``predict_batch_udf`` ships it to the workers and calls it once per worker process; later batches of any
task there use the cached model. Spark cuts batches by rows; a model's memory follows the bytes of its inputs, so each batch is
cut once more, at ``max_bytes`` of text (a longer text is a batch of its own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scorer import scorer_text

MakeModel = Callable[[], Callable[[np.ndarray], np.ndarray]]


def byte_bounded(texts: np.ndarray, max_bytes: int) -> Iterator[slice]:
    """Consecutive slices of ``texts`` of at most ``max_bytes`` bytes of UTF-8 each, at least one text long."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(str(text).encode())
        if i > start and held + size > max_bytes:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if len(texts) > start:
        yield slice(start, len(texts))


def score_udf(make_model: MakeModel, batch_rows: int = 256, max_bytes: int = 1 << 20):
    """A column function: text column -> probability, null for a null text."""

    def make():
        model = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.empty(len(texts))
            for part in byte_bounded(texts, max_bytes):
                out[part] = model(texts[part])
            return out

        return predict

    udf = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_rows)
    return lambda text: F.when(text.isNotNull(), udf(F.coalesce(text, F.lit(""))))


def predictor_score_fn(make_model: MakeModel, dataset: str = "boolq", batch_rows: int = 256, max_bytes: int = 1 << 20):
    """A neural scorer as ``sequential_final`` takes it: adds ``score`` to rows with prompt_text, answer, response and pred."""
    score = score_udf(make_model, batch_rows, max_bytes)
    return lambda rows, tier: rows.withColumn("score", score(scorer_text(dataset)))


def predictor_scores(make_model: MakeModel, labelled: DataFrame, strategy: str, dataset: str = "boolq", batch_rows: int = 256, max_bytes: int = 1 << 20) -> DataFrame:
    """(strategy, prompt_id, tier, score) of labelled answers, as the sweeps take them."""
    score = score_udf(make_model, batch_rows, max_bytes)
    return labelled.select(F.lit(strategy).alias("strategy"), "prompt_id", "tier", score(scorer_text(dataset)).alias("score"))
