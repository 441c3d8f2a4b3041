"""Shared awkward inputs: nulls everywhere, empty and long texts, repeated rows, ties, clashing extra columns."""

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHING = (
    "score", "predicted", "held_out", "fingerprint", "fp", "tie", "component_id", "num", "at", "size", "target", "taken", "block", "rank",
    "drop", "site", "pos", "h1", "first", "host", "labels", "spans", "sequence_id", "offset", "length", "piece", "kept", "__nth", "__key0", "__drop", "__ranges",
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 16 & 15] + str(x % 97))
        if i % 11 == 10:
            out[-1] += ".\n"
    return " ".join(out)


def rows():
    long_text = prose(5, 30_000)
    return [
        (1, prose(1, 120), "en", "a", 1), (2, prose(2, 60), "en", "b", 2), (3, prose(1, 120), "de", "b", 3), (4, None, "en", "a", None),
        (5, "", "en", None, 0), (6, " \t\n\x0b\x0c\r ", None, "c", 7), (7, "One", "en", "c", 3), (8, "one two", "en", "c", 7),
        (9, long_text, "en", "a", len(long_text)), (10, "x" * 20_000, "en", "d", 20_000), (11, "İ K ß É 漢字 😀 \x00 $1 \\0", "fr", "d", 9),
        (11, "İ K ß É 漢字 😀 \x00 $1 \\0", "fr", "d", 9), (12, "same line\nsame line\nsame line", "en", "e", 1), (None, prose(3, 80), "en", "a", 5),
        (None, None, None, None, None), (13, "\n\n\n", "en", "f", 3), (2, prose(2, 60), "en", "b", 2), (14, prose(1, 119) + " other", "en", "g", 1),
    ]


def awkward(spark, partitions: int = 3):
    """The rows above with extra columns whose names clash with those that operators use."""
    df = spark.createDataFrame(rows(), DOC).repartition(partitions)
    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHING)})


def empty(spark):
    return awkward(spark).limit(0)


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (9, 0), (99, 1), (12, 0)], "doc_id long, quality int")
