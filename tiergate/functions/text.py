"""Text column helpers (all built-in Spark functions, no UDF).

Whitespace is the ASCII class ``[ \\t\\n\\x0B\\f\\r]`` written out, so the meaning is the same in Java regex and
in other engines' regex dialects (``\\s`` differs between them on ``\\x0B``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NON_ECHO_MARKER

WS = "[ \\t\\n\\x0B\\f\\r]"
NOT_ALNUM_WS = "[^A-Za-z0-9 \\t\\n\\x0B\\f\\r]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_alnum(text) -> Column:
    """newline -> space, then every character that is not ASCII letter, digit or whitespace -> space."""
    t = F.regexp_replace(col(text), "\n", " ")
    return F.regexp_replace(t, NOT_ALNUM_WS, " ")


def first_words(text, n) -> Column:
    """The first ``n`` (number or column) whitespace-separated words joined by one space."""
    t = F.regexp_replace(col(text), f"^{WS}+", "")
    return F.array_join(F.slice(F.split(t, f"{WS}+"), 1, n), " ")


def echoes(model) -> Column:
    """True for models that repeat the prompt in front of the answer (no 'flan' in the name)."""
    return ~col(model).contains(NON_ECHO_MARKER)


def strip_echo(response, prompt_text, model) -> Column:
    """Drop the first ``length(prompt_text)`` characters of the response for echoing models."""
    return strip_head(response, F.length(col(prompt_text)), model)


def strip_head(response, n_chars, model) -> Column:
    """``strip_echo`` where only the length of the prompt is at hand."""
    r = col(response)
    return F.when(echoes(model), F.substr(r, col(n_chars) + 1)).otherwise(r)


def first_line(text) -> Column:
    return F.substring_index(col(text), "\n", 1)


def word_count(text) -> Column:
    """Number of whitespace-separated words (0 for empty or blank text)."""
    t = F.regexp_replace(col(text), f"^{WS}+|{WS}+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{WS}+")))
