"""Deterministic hash buckets built from ``md5`` so every engine (and a plain Python loop) can reproduce them.

``h(x)`` = first 4 hex digits of md5(x) as an integer, modulo 100. Used for stub answers and scores, seeded
sampling and hash splits. All JVM-side expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def key(*parts) -> Column:
    """String key from parts; numbers are rendered with ``cast(.. as string)``."""
    return F.concat(*[_as_col(p).cast("string") for p in parts])


def hex_bits(x: Column, digits: int = 4) -> Column:
    return F.conv(F.substring(F.md5(x), 1, digits), 16, 10).cast("bigint")


def h(x: Column, mod: int = 100) -> Column:
    return hex_bits(x, 4) % F.lit(mod)


def h_py(x: str, mod: int = 100) -> int:
    """Same as ``h`` in plain Python (for pandas-side responders and tests)."""
    return int(hashlib.md5(x.encode("utf-8")).hexdigest()[:4], 16) % mod
