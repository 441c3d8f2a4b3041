"""Answer -> label rules on hand-made edge rows (FIXTURES section 3)."""

import pytest
from pyspark.sql import functions as F

from tiergate.functions import rules


def _rule(task):
    return lambda text, model: rules.class_label(task, text, model)


def _apply(spark, fn, texts, model="Phi-3-mini-4k-instruct"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"), F.lit(model))).collect()]


def test_boolq_rule_non_flan(spark):
    texts = ["True.", "**Yes**, because", "a b c d e true", "", None, "\n\ntrue", "No.", "yesterday"]
    assert _apply(spark, _rule("boolq"), texts) == [1, 1, 0, 0, 0, 1, 0, 1]


def test_boolq_rule_flan_keeps_all_words(spark):
    assert _apply(spark, _rule("boolq"), ["a b c d e true", "**Yes**"], model="flan-t5-xl") == [1, 1]


def test_mnli_rules(spark):
    texts = ["Contradiction (2), not 1", "entailment", "CONTRADICTS", "Neutral", ""]
    assert _apply(spark, rules.mnli_cascade, texts) == [1, 0, 2, 1, 0]
    # evaluator form: non-flan cleaned; one model keeps 10 words only
    long = "w " * 12 + "neutral"
    assert _apply(spark, _rule("mnli"), [long], model="Phi-3-small-8k-instruct") == [0]
    assert _apply(spark, _rule("mnli"), [long], model="Phi-3-mini-4k-instruct") == [1]


@pytest.mark.parametrize(
    "fn, texts, expected",
    [
        (_rule("qnli"), ["It does not entail.", "entailment", "NOT ENTAILED"], [1, 0, 1]),
        (_rule("wnli"), ["0", "not entailment", "entailment"], [0, 0, 1]),
        (_rule("cola"), ["0", "Not acceptable", "acceptable"], [0, 0, 1]),
        (_rule("sst2"), ["1", "Positive!", "negative"], [1, 1, 0]),
        (_rule("mrpc"), ["0", "yes"], [0, 1]),
        (_rule("copa"), ["choice1", "0", "choice2"], [0, 0, 1]),
    ],
)
def test_binary_rules(spark, fn, texts, expected):
    assert _apply(spark, fn, texts) == expected


def test_multilabel_rules(spark):
    df = spark.createDataFrame([(None, "Pro-vaccine and NEUTRAL"), ("ProVax", "anti-vaccine")], "g string, t string")
    out = df.select(rules.gold_vector("vax", "g"), rules.vector_label("vax", "t", F.lit("Phi-3"))).collect()
    assert [list(r[0]) for r in out] == [[0, 0, 0], [1, 0, 0]]
    assert [list(r[1]) for r in out] == [[1, 0, 1], [0, 1, 0]]
    df = spark.createDataFrame([("side-effect, pharma",)], "t string")
    vec = df.select(rules.vector_label("caves", "t", F.lit("Phi-3"))).first()[0]
    assert vec[2] == 1 and vec[8] == 1 and sum(vec) == 2
    df = spark.createDataFrame([("The text: hate speech",), ("Hate speech.",)], "t string")
    assert [list(r[0]) for r in df.select(rules.vector_label("hatex", "t", F.lit("Phi-3"))).collect()] == [[0, 0, 0], [1, 0, 0]]


def test_stsb_rule(spark):
    texts = ["4.5", "4.x", "3/5", "3", "", "abc", None]
    assert _apply(spark, lambda t, _: rules.number_of(t), texts) == [4.5, 4.0, 3.0, 3.0, None, None, None]


def test_echo_strip(spark):
    from tiergate.functions.text import strip_echo

    df = spark.createDataFrame(
        [("Prompt é 😀 ", "Prompt é 😀 True", "Phi-3-mini-4k-instruct"), ("long prompt", "short", "Phi-3"), ("p", "Yes", "flan-t5-xl")],
        "p string, r string, m string",
    )
    assert [r[0] for r in df.select(strip_echo("r", "p", "m")).collect()] == ["True", "", "Yes"]
