"""Answer -> label rules (L1-L15) as a table, and the column expressions that apply it.

A rule reads the answer text *after* the echo strip (P6) and the model name. The table (``task_rules``) holds a row per
task: how the answer is prepared, which words mean which class, and how the gold text is read. It is one literal
looked up by task, so a task more is a row more, and generated code does not grow with the tasks. Earlier words win;
"has" is a substring test on the lower-cased text. A null answer falls to the last branch.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import clean_alnum, col, echoes, first_words

CLASS_TASKS = ("boolq", "mnli", "qnli", "wnli", "cola", "sst2", "mrpc", "copa")
MULTILABEL_TASKS = ("vax", "caves", "hatex")
NUMBER_TASKS = ("stsb",)
TEXT_TASKS = ("samsum", "cnn_dm", "dolly")
ALL_TASKS = CLASS_TASKS + MULTILABEL_TASKS + NUMBER_TASKS + TEXT_TASKS

RULE_SCHEMA = (
    "map<string, struct<kind string, cleaned boolean, keep_words map<string, int>, head int, otherwise int, "
    "words array<struct<word string, class int>>, gold_words array<array<string>>, answer_words array<array<string>>, gold_if_null string>>"
)


def task_rules() -> dict[str, dict]:
    """The rule table. ``words``: tried in order, the first one the lower-cased answer holds names the class, else
    ``otherwise``. ``cleaned``: answers of echoing models lose everything but letters, digits and spaces;
    ``keep_words``: and are cut to so many words, for models whose name holds the key ("" for all). ``head``: only so
    many characters count. Label vectors: one list of words per position, for gold and for answers."""

    def by_words(groups, otherwise, **more):
        return {"kind": "class", "otherwise": otherwise, "words": [{"word": w, "class": c} for words, c in groups for w in words]} | more

    def vector(gold, answer, **more):
        return {"kind": "vector", "gold_words": [list(g) for g in gold], "answer_words": [list(a) for a in answer]} | more

    single = lambda words: [(w,) for w in words]
    return {
        "boolq": by_words([(C.BOOLQ_POSITIVE, 1)], 0, cleaned=True, keep_words={"": C.BOOLQ_KEEP_WORDS}),
        "mnli": by_words([(C.MNLI_NEUTRAL, 1), (C.MNLI_CONTRADICTION, 2)], 0, cleaned=True, keep_words={C.MNLI_PHI_SMALL: C.MNLI_KEEP_WORDS_PHI_SMALL}),
        "qnli": by_words([(C.QNLI_NOT_ENTAIL, 1)], 0),
        "wnli": by_words([(C.WNLI_ZERO, 0)], 1),
        "cola": by_words([(C.COLA_ZERO, 0)], 1),
        "sst2": by_words([(C.SST2_ONE, 1)], 0),
        "mrpc": by_words([(C.MRPC_ZERO, 0)], 1),
        "copa": by_words([(C.COPA_ZERO, 0)], 1),
        "vax": vector(single(C.VAX_GOLD_LABELS), single(C.VAX_PRED_LABELS), gold_if_null=C.VAX_NULL_GOLD),
        "caves": vector(single(C.CAVES_LABELS), single(C.CAVES_LABELS)),
        "hatex": vector(single(C.HATEX_GOLD_LABELS), C.HATEX_PRED_LABELS, head=C.HATEX_PREFIX_CHARS),
        "stsb": {"kind": "number"},
        **{t: {"kind": "text"} for t in TEXT_TASKS},
    }


def rule_column(task: Column, rules: dict[str, dict] | None = None) -> Column:
    return F.element_at(F.from_json(F.lit(json.dumps(rules or task_rules())), RULE_SCHEMA), task)


def prepared_answer(answer: Column, model: Column, rule: Column) -> Column:
    """The answer as the rule reads it: cleaned and cut for echoing models where the rule says so, lower-cased, cut to ``head``."""
    clean = clean_alnum(answer)
    limits = F.filter(F.map_entries(rule["keep_words"]), lambda e: model.contains(e["key"]))
    limit = F.get(limits, F.lit(0))["value"]
    cut = F.when(limit.isNotNull(), first_words(clean, limit)).otherwise(clean)
    text = F.lower(F.when(rule["cleaned"] & echoes(model), cut).otherwise(answer))
    return F.when(rule["head"].isNotNull(), F.substr(text, F.lit(1), rule["head"])).otherwise(text)


def class_of(text: Column, rule: Column) -> Column:
    """Class of a prepared answer; a null answer gets the last branch. The answer is prepared once, not for every word."""
    hits = F.transform(F.array(text), lambda t: F.filter(rule["words"], lambda w: F.coalesce(t.contains(w["word"]), F.lit(False))))
    return F.coalesce(F.get(F.get(hits, F.lit(0)), F.lit(0))["class"], rule["otherwise"])


def vector_of(text: Column, groups: Column) -> Column:
    """0/1 per group of words: does the text hold any of them."""
    return F.transform(groups, lambda g: F.coalesce(F.exists(g, lambda w: text.contains(w)), F.lit(False)).cast("int"))


def number_of(text: Column) -> Column:
    """'d.d' as a number, otherwise the first character; null when that is not a number."""
    head = F.substring(text, 1, 3)
    return F.when(head.rlike("^[0-9][.][0-9]"), head.try_cast("double")).otherwise(F.substring(text, 1, 1).try_cast("double"))


def class_label(task: str, text, model) -> Column:
    """Class of an answer by the rule of one task."""
    rule = rule_column(F.lit(task))
    return class_of(prepared_answer(col(text), col(model), rule), rule)


def vector_label(task: str, text, model) -> Column:
    rule = rule_column(F.lit(task))
    return vector_of(prepared_answer(col(text), col(model), rule), rule["answer_words"])


def gold_vector(task: str, gold) -> Column:
    rule = rule_column(F.lit(task))
    return vector_of(F.coalesce(col(gold), rule["gold_if_null"]), rule["gold_words"])


def mnli_cascade(text, model=None) -> Column:
    """L2, cascade form: no cleaning, lower case, then the 3-way rule."""
    rule = rule_column(F.lit("mnli"))
    return class_of(F.lower(col(text)), rule)


#: data set -> (text, model) -> class, as the cascades label answers.
CASCADE_RULES = {"boolq": partial(class_label, "boolq"), "mnli": mnli_cascade}
