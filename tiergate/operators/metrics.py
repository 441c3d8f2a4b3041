"""Quality metrics as two-level aggregations (A1-A5).

All of them first reduce rows to a small table of counts with map-side partial aggregation, so the only
shuffle moves (group x label) counters, never rows. Outputs are fractions (not x100), rounded to ``DIGITS``
decimals so that engines that sum in a different order still print the same number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def _safe_div(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def macro_prf(df: DataFrame, group_cols: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Macro precision / recall / F1 over the labels seen in gold or pred (A1).

    Per label: P = tp / predicted, R = tp / support, F1 = 2 tp / (support + predicted); a zero denominator gives 0.
    Rows with a null gold or pred are left out and counted in ``unlabelled``.
    Output: group_cols + n, unlabelled, m_pre, m_rec, m_f1.
    """
    g = list(group_cols)
    cells = df.groupBy(*g, F.col(gold).alias("_g"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    return macro_prf_from_cells(cells, g)


def macro_prf_from_cells(cells: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """A1 from confusion cells ``(group..., _g, _p, _n)`` - lets several metrics share one aggregation of the rows."""
    g = list(group_cols)
    none = F.lit(0).cast("bigint")
    valid = F.col("_g").isNotNull() & F.col("_p").isNotNull()
    hit = F.when(F.col("_g") == F.col("_p"), F.col("_n")).otherwise(none)

    def share(label, ng, np_, tp, lost):
        return F.struct(label.alias("label"), ng.alias("ng"), np_.alias("np"), tp.alias("tp"), lost.alias("lost"))

    seen = F.array(share(F.col("_g"), F.col("_n"), none, hit, none), share(F.col("_p"), none, F.col("_n"), none, none))
    lost = F.array(share(F.lit(None).cast(cells.schema["_g"].dataType), none, none, none, F.col("_n")))
    per_cell = cells.select(*g, F.explode(F.when(valid, seen).otherwise(lost)).alias("c"))
    per_label = per_cell.groupBy(*g, F.col("c.label").alias("label")).agg(
        F.sum("c.ng").alias("ng"), F.sum("c.np").alias("np"), F.sum("c.tp").alias("tp"), F.sum("c.lost").alias("lost")
    )
    named = F.col("label").isNotNull()
    scored = per_label.select(
        *g, "ng", "lost",
        F.when(named, _safe_div(F.col("tp"), F.col("np"))).alias("p"),
        F.when(named, _safe_div(F.col("tp"), F.col("ng"))).alias("r"),
        F.when(named, _safe_div(2 * F.col("tp"), F.col("ng") + F.col("np"))).alias("f"),
    )
    return scored.groupBy(*g).agg(
        F.sum("ng").cast("bigint").alias("n"),
        F.sum("lost").cast("bigint").alias("unlabelled"),
        F.round(F.avg("p"), DIGITS).alias("m_pre"),
        F.round(F.avg("r"), DIGITS).alias("m_rec"),
        F.round(F.avg("f"), DIGITS).alias("m_f1"),
    )


def macro_prf_multilabel(df: DataFrame, group_cols: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Macro P/R/F1 on 0/1 vectors (A2): per position counts, then the mean over *all* positions."""
    g = list(group_cols)
    pos = df.select(*g, F.posexplode(F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p"))).alias("i", "v"))
    per_pos = pos.groupBy(*g, "i").agg(
        F.sum(F.col("v.g") * F.col("v.p")).cast("bigint").alias("tp"),
        F.sum("v.g").cast("bigint").alias("ng"),
        F.sum("v.p").cast("bigint").alias("np"),
        F.count(F.lit(1)).alias("rows"),
    )
    scored = per_pos.select(
        *g,
        "rows",
        _safe_div(F.col("tp"), F.col("np")).alias("p"),
        _safe_div(F.col("tp"), F.col("ng")).alias("r"),
        _safe_div(2 * F.col("tp"), F.col("ng") + F.col("np")).alias("f"),
    )
    return scored.groupBy(*g).agg(
        F.max("rows").cast("bigint").alias("n"),
        F.round(F.avg("p"), DIGITS).alias("m_pre"),
        F.round(F.avg("r"), DIGITS).alias("m_rec"),
        F.round(F.avg("f"), DIGITS).alias("m_f1"),
    )


def accuracy(df: DataFrame, group_cols: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """A3: share of rows where pred equals gold."""
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col(gold) == F.col(pred)).cast("double")), DIGITS).alias("accuracy"),
    )


def regression_metrics(df: DataFrame, group_cols: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """A4, A5: RMSE, MAE and R2 over rows with a number on both sides; the others are counted in ``unparsed``.

    One pass; SS_tot is n times the population variance, which Spark updates without cancellation. R2 is null when
    gold is constant.
    """
    both = F.col(gold).isNotNull() & F.col(pred).isNotNull()
    g_val = F.when(both, F.col(gold).cast("double"))
    e = g_val - F.col(pred).cast("double")
    sums = df.groupBy(*group_cols).agg(
        F.count(g_val).alias("n"),
        F.count(F.when(~both, F.lit(1))).alias("unparsed"),
        F.var_pop(g_val).alias("vg"),
        F.sum(e * e).alias("see"),
        F.sum(F.abs(e)).alias("sae"),
    )
    return sums.select(
        *group_cols, "n", "unparsed",
        F.round(F.sqrt(F.col("see") / F.col("n")), 6).alias("rmse"),
        F.round(F.col("sae") / F.col("n"), 6).alias("mae"),
        F.round(F.when(F.col("vg") > 0, 1 - F.col("see") / (F.col("n") * F.col("vg"))), 6).alias("r2"),
    )
