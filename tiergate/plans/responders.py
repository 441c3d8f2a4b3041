"""Responders: the plug-in point that stands for model inference (M1).

``pandas_responder`` runs a model over a batch plan with ``mapInPandas`` (Arrow batches). The model comes from a
factory that is called once per Python worker task; it sees the rows of one batch together, in plan order, and never
the gold label. Its answers are written once to the shared folder, so a model that does not repeat itself is asked
once for each row, whatever is computed from the answers later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import config as C
from ..session import shuffle_width, staged


def prepare_plan(planned: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Lay a batch plan out for inference once, for every tier that will run over it.

    Range partitioning on (group, batch) keeps each batch inside one task, sorted. ``planned`` holds the group columns,
    ``prompt_id, prompt_text, batch_id``; other columns (the gold label among them) do not reach a model.
    """
    keys = [*group_cols, "batch_id"]
    narrow = planned.select(*keys, "prompt_id", "prompt_text")
    laid = narrow.repartitionByRange(shuffle_width(planned.sparkSession), *keys).sortWithinPartitions(*keys, "prompt_id")
    return laid


def pandas_responder(
    planned: DataFrame, tier: C.Tier, model_factory: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """(group..., prompt_id, tier, model, batch_id, response): one tier over a batch plan.

    Batches are cut per group: equal batch ids of different groups (data sets, runs) are different batches.
    """
    groups = list(group_cols)
    keys = [*groups, "batch_id"]
    fields = {f.name: f.dataType.simpleString() for f in planned.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in groups), "prompt_id bigint, tier int, model string, batch_id bigint, response string"])

    def answer(rows: pd.DataFrame, generate) -> pd.DataFrame:
        out = {c: rows[c].to_numpy() for c in groups} | {
            "prompt_id": rows["prompt_id"].to_numpy(), "tier": tier.tier, "model": tier.model,
            "batch_id": rows["batch_id"].to_numpy(), "response": generate(rows).to_numpy(),
        }
        return pd.DataFrame(out)

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = model_factory()
        pending = None  # rows of the last, possibly incomplete batch of the previous Arrow chunk
        for rows in chunks:
            rows = rows if pending is None else pd.concat([pending, rows], ignore_index=True)
            if rows.empty:
                continue
            new = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, starts[1:]):
                yield answer(rows.iloc[lo:hi], generate)
            pending = rows.iloc[starts[-1] :]
        if pending is not None and not pending.empty:
            yield answer(pending, generate)

    return staged(prepare_plan(planned, groups).mapInPandas(run, schema), "model-answers")
