"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiergate.session import scratch_path
from tiergate.sources.tables import table_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space between words, as the inside of a character class (space, tab, line feed, VT, FF, carriage return).
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage with a reliable copy: a lost executor never makes an earlier step run again, and what was
    computed once (model draws, tokens, fingerprints) is never computed twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``stage`` wrote and that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/tiergate/llm/" in folder:  # only what stage() wrote
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, evaluated once per row.

    A lambda that names a computed column runs that computation again for each element; binding it as a lambda
    variable of a one-element array does not.
    """
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (names are compared as Spark does, without case)."""
    taken, name, i = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        i += 1
        name = f"{stem}_{i}"
    return name


def row_key(doc_id: Column, tie: Column, *others: Column) -> list[Column]:
    """Keys without nulls that name a row by id, text hash and other columns, so that joins and windows on them share
    one partitioning (null-safe equality does not)."""
    rest = F.xxhash64(doc_id.isNull(), *(x for c in others for x in (c.isNull(), c)))
    return [F.coalesce(doc_id, F.lit(-1).cast("long")), tie, rest]


def with_keys(df: DataFrame, names: list[str], keys: list[Column]) -> DataFrame:
    return df.withColumns(dict(zip(names, keys)))
