"""Seeded sampling and splits.

The studied programs sample without a seed; here every choice is a function of (row key, seed), so a re-run or a
re-executed task gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h, key


def sample_order(key_col: str, seed: int):
    return F.md5(key(F.col(key_col), "-sample-", F.lit(seed)))


def sample_n(df: DataFrame, n: int, key_col: str = "prompt_id", seed: int = 42) -> DataFrame:
    """N rows in seeded pseudo-random order; ``orderBy(..).limit(n)`` plans as a top-k (no full sort)."""
    return df.select("*", sample_order(key_col, seed).alias("_order")).orderBy("_order", key_col).limit(n).drop("_order")


def split_positional(df: DataFrame, n: int, first: int, key_col: str = "prompt_id", seed: int = 42) -> DataFrame:
    """Sample n rows, then the first ``first`` of the sample order are 'train', the rest 'test'.

    The window runs over at most ``n`` rows (the top-k output), never the full table.
    """
    s = df.select("*", sample_order(key_col, seed).alias("_order")).orderBy("_order", key_col).limit(n)
    rn = F.row_number().over(Window.orderBy("_order", key_col))
    return s.select(
        "*", rn.alias("sample_pos")
    ).select(
        *[c for c in df.columns], "sample_pos", F.when(F.col("sample_pos") <= first, F.lit("train")).otherwise(F.lit("test")).alias("split")
    )


def split_hash(df: DataFrame, validation_pct: int, key_col: str = "prompt_id", seed: int = 42) -> DataFrame:
    """P5: 'validation' when h(key, seed) < pct, else 'train'. Row-local, no shuffle."""
    b = h(key(F.col(key_col), "-split-", F.lit(seed)))
    return df.select("*", F.when(b < validation_pct, F.lit("validation")).otherwise(F.lit("train")).alias("split"))
