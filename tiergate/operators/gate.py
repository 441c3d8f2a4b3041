"""The gate (P8) and the set operators around it.

Accept when ``score > threshold`` (strict); everything else escalates, including a null score. The two sides are
disjoint and together hold every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted_condition(score: Column, threshold: Column) -> Column:
    """True only for a score strictly above the threshold; null score -> False."""
    return F.coalesce(score > threshold, F.lit(False))


def gate_split(scored: DataFrame, threshold: float, score_col: str = "score") -> tuple[DataFrame, DataFrame]:
    acc = accepted_condition(F.col(score_col), F.lit(float(threshold)))
    return scored.where(acc), scored.where(~acc)


def route(scored: DataFrame, threshold: float, score_col: str = "score") -> DataFrame:
    """Tag rows with ``route`` = 'accept' / 'escalate' (one pass; the two filters of ``gate_split`` in one column)."""
    acc = accepted_condition(F.col(score_col), F.lit(float(threshold)))
    return scored.select("*", F.when(acc, F.lit("accept")).otherwise(F.lit("escalate")).alias("route"))


def remaining_anti(all_rows: DataFrame, accepted: DataFrame, keys: str | list[str] = "prompt_id") -> DataFrame:
    """Rows not yet accepted."""
    keys = [keys] if isinstance(keys, str) else keys
    return all_rows.join(accepted.select(*keys), keys, "left_anti")


def accepted_semi(all_rows: DataFrame, accepted: DataFrame, keys: str | list[str] = "prompt_id") -> DataFrame:
    """Rows of ``all_rows`` whose key was accepted."""
    keys = [keys] if isinstance(keys, str) else keys
    return all_rows.join(accepted.select(*keys), keys, "left_semi")
