"""Personal data by weak supervision.

Candidate spans come from strict and loose expressions. Labelers vote on each: format, check digits and ranges,
gazetteers (mail domains, dialling codes, reserved ranges), and words of the context for and against; a labeler may
abstain. Expectation maximisation over the vote patterns of all documents estimates each labeler's reliability and the
share of real spans of each kind (a two-class Dawid-Skene model). A logistic span classifier is then trained on the
posteriors, from votes and the span's shape, and decides on the candidates that no base rule has settled.

A candidate is reduced to a key (kind, votes, shape) of few values, so Spark counts keys over all documents, the driver
fits on the counts, and the decision goes back as a set of accepted keys. Texts are read once, in Arrow batches;
matches that a base rule accepts always stay.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergate.llm.common import stage

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
LABELERS = ("format", "checks", "gazetteer", "context_for", "context_against")
YES, NO, ABSTAIN = "1", "0", "-"

# A match of these kinds takes a run of characters whole, so one that fails at the start of a run fails at every later
# start in it: an IP is tried where a run of digits starts, a mail address once per "@", and no run is read again.
MAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,5}\) ?|[0-9]{3,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}

MAIL_DOMAINS = frozenset("com org net edu gov mil int info io de fr es it nl uk eu ch at be pl se us ca au jp cn in br mx".split())
DIAL_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "98")
FOR = {
    "email": "mail email e-mail contact write correo courriel kontakt".split(),
    "ip": "ip address host server login from client".split(),
    "card": "card visa mastercard amex credit debit payment karte tarjeta carte".split(),
    "phone": "phone tel telephone call mobile fax cell contact telefon teléfono téléphone".split(),
    "ssn": "ssn social security".split(),
    "iban": "iban account bank konto cuenta compte".split(),
}
AGAINST = frozenset("version v release isbn issn doi section chapter page id order ref token hash build sku serial ticket".split())
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


# --- base rules -----------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_ok(kind: str, match: str) -> bool:
    """Whether a match of the base expression of ``kind`` is accepted."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        digits = _digits(match)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(_digits(match)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the mail expression: the run of local characters before each "@", and the domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        domain = MAIL_DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            yield lo, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, accepted) of every match of the base expressions, leftmost and non-overlapping per kind."""
    for a, b in _emails(text):
        yield "email", a, b, True
    for kind, expression in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in expression.finditer(text):
            yield kind, *m.span(), base_ok(kind, m[0])


# --- labelers -------------------------------------------------------------------------------------------------------


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes_of(kind: str, span: str, before: str, strict: bool | None) -> str:
    """One vote per labeler. ``strict``: verdict of the base rule on a base match, None for a loose candidate."""
    digits = _digits(span)
    form = ABSTAIN if strict is None else YES if strict else NO
    checks, known = ABSTAIN, ABSTAIN
    if kind == "card":
        checks = YES if 13 <= len(digits) <= 19 and luhn(digits) else NO
        known = YES if digits[0] in "3456" else NO
    elif kind == "phone":
        checks = YES if 7 <= len(digits) <= 15 else NO
        known = (YES if digits.startswith(DIAL_CODES) else NO) if span[0] == "+" else ABSTAIN
    elif kind == "ip":
        try:
            address = ipaddress.ip_address(span)
            checks, known = YES, NO if address.is_loopback or address.is_unspecified else YES
        except ValueError:
            checks = NO
    elif kind == "email":
        tail = re.split(r"[^A-Za-z]+", span.lower())
        known = YES if tail[-1] in MAIL_DOMAINS else NO
        checks = NO if ".." in span else YES
    elif kind == "ssn":
        area, group, serial = digits[:3], digits[3:5], digits[5:]
        checks = NO if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else YES
    elif kind == "iban":
        checks = YES if _iban_ok(span) else NO
    words = [w.lower() for w in _WORD.findall(before)]
    context = YES if any(w in FOR[kind] for w in words[-5:]) else ABSTAIN
    against = NO if (words and words[-1] in AGAINST) or before.rstrip().endswith(("=", "#", "$")) else ABSTAIN
    return form + checks + known + context + against


def _place(c: str) -> str:
    return "e" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"


def shape_of(span: str, before: str, after: str) -> str:
    """What stands around a span, how long it is, and how it is divided; 4 x 4 x 6 x 8 values."""
    size = min(5, len(span).bit_length())
    inside = int(" " in span) + 2 * int("-" in span or "." in span) + 4 * int("(" in span)
    return f"{_place(before[-1:])}{_place(after[:1])}{size}{inside}"


def candidates(text: str) -> Iterator[tuple[str, int, int, bool, str]]:
    """(kind, start, end, accepted by a base rule, key) of every candidate span of a whole text."""

    def key(kind: str, a: int, b: int, strict: bool | None) -> str:
        before, span = text[max(0, a - 48) : a], text[a:b]
        return f"{kind}|{votes_of(kind, span, before, strict)}|{shape_of(span, before, text[b : b + 1])}"

    for kind, a, b, ok in base_matches(text):
        if ok or kind != "card" or b - a >= 12:  # short digit runs are no candidates for cards
            yield kind, a, b, ok, key(kind, a, b, ok)
    for kind, expression in LOOSE.items():
        for m in expression.finditer(text) if kind != "email" else _bracketed(text):
            yield kind, *m.span(), False, key(kind, *m.span(), None)


_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)


def _bracketed(text: str) -> Iterator[re.Match]:
    """Matches of the loose mail expression, tried only around a bracketed "at"."""
    done = 0
    for hit in _AT.finditer(text):
        m = LOOSE["email"].search(text, max(done, hit.start() - 66), min(len(text), hit.end() + 300))
        if m and m.start() < hit.start() < m.end():
            done = m.end()
            yield m


# --- label model and span classifier --------------------------------------------------------------------------------


def fit_reliabilities(votes: np.ndarray, kind: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1 / 0 / 1, with -1 for abstain): posteriors, and accuracy of each labeler per class.

    The classes start from the majority of the votes; Beta(4, 2) priors keep a labeler that rarely votes near "more
    often right than wrong", and Beta(1, 1) the share of a kind.
    """
    yes, no = votes == 1, votes == 0
    post = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1.0)
    kinds = np.unique(kind)
    for _ in range(rounds):
        right_1 = ((yes * (weight * post)[:, None]).sum(0) + 3) / (((yes | no) * (weight * post)[:, None]).sum(0) + 4)
        right_0 = ((no * (weight * (1 - post))[:, None]).sum(0) + 3) / (((yes | no) * (weight * (1 - post))[:, None]).sum(0) + 4)
        share = np.zeros(len(kind))
        for k in kinds:
            own = kind == k
            share[own] = ((weight * post)[own].sum() + 1) / (weight[own].sum() + 2)
        z = np.log(share / (1 - share))
        z += (yes * np.log(right_1 / (1 - right_0)) + no * np.log((1 - right_1) / right_0)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, np.stack([right_0, right_1])


def _one_hot(keys: list[str]) -> np.ndarray:
    """Votes and shape of keys as 0/1 columns, fixed by the code, not by the data."""
    out = []
    for key in keys:
        kind, votes, shape = key.split("|")
        row = [1.0, *(kind == k for k in KINDS)]
        row += [v == c for v in votes for c in (YES, NO)]
        row += [shape[0] == c for c in "esap"] + [shape[1] == c for c in "esap"]
        row += [shape[2] == str(c) for c in range(6)] + [bool(int(shape[3]) & c) for c in (1, 2, 4)]
        out.append(row)
    return np.array(out, float).reshape(len(keys), -1)


def fit_span_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression on soft targets (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (weight * (target - p)) - ridge * w)
    return w


def accepted_keys(counts: dict[str, int], threshold: float = 0.5) -> set[str]:
    """Keys whose spans the trained classifier accepts, from the number of candidates of every key."""
    if not counts:
        return set()
    keys = sorted(counts)
    votes = np.array([[{YES: 1, NO: 0, ABSTAIN: -1}[v] for v in k.split("|")[1]] for k in keys])
    weight = np.array([counts[k] for k in keys], float)
    post, _ = fit_reliabilities(votes, np.array([k.split("|")[0] for k in keys]), weight)
    x = _one_hot(keys)
    p = 1 / (1 + np.exp(-np.clip(x @ fit_span_classifier(x, post, weight), -30, 30)))
    heard = (votes >= 0).any(1)  # a span on which every labeler abstains is left alone
    return {k for k, ok in zip(keys, (p >= threshold) & heard) if ok}


# --- over documents -------------------------------------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,key:string>>"


def _text_of(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def resolve(cands, accepted: set[str]) -> list[tuple[str, int, int]]:
    """Base spans, and accepted others that overlap no base span and no earlier, longer accepted one."""
    base = [(c["kind"], c["start"], c["end"]) for c in cands if c["base"]]
    more = sorted((c["start"], -c["end"], KINDS.index(c["kind"])) for c in cands if not c["base"] and c["key"] in accepted)
    edges = sorted((a, b) for _, a, b in base)
    out, upto, i = list(base), -1, 0
    for a, minus_b, k in more:
        while i < len(edges) and edges[i][1] <= a:
            i += 1
        near = any(s < -minus_b and e > a for s, e in edges[i : i + len(KINDS)])
        if a >= upto and not near:
            out.append((KINDS[k], a, -minus_b))
            upto = -minus_b
    return out


def candidate_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, spans): every row of ``docs`` with its candidate spans."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            spans = [[dict(zip(("kind", "start", "end", "base", "key"), c)) for c in candidates(t or "")] for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "spans": spans})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(extract, f"doc_id long, spans {SPANS}")


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    Counts and digest are of the base rules' spans; ``spans`` has all, as kind:start:end in code points (end
    exclusive). A null or empty text has none: zero counts, the digest of the empty string, and empty ``spans``.
    Repeated rows are treated alike; other columns are ignored; an empty table gives an empty result.
    """
    table = stage(candidate_table(docs, text), "pii-candidates")
    counts = table.select(F.explode("spans.key").alias("key")).groupBy("key").count()
    accepted = accepted_keys({r["key"]: r["count"] for r in counts.collect()}, threshold)  # keys have few values

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def digest(column: pd.Series) -> pd.DataFrame:
        out = []
        for cands in column:
            base = [(c["kind"], c["start"], c["end"]) for c in cands if c["base"]]
            numbers = [sum(s[0] == k for s in base) for k in KINDS[:4]]
            out.append((*numbers, hashlib.sha256(_text_of(base).encode()).hexdigest(), _text_of(resolve(cands, accepted))))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return table.select("doc_id", digest("spans").alias("r")).select("doc_id", "r.*")
