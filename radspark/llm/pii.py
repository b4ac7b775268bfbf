"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, plus-digit, digit-dot-digit,
adjoining digits and cue words of accounts. A deterministic parser for each kind expands the anchor to
its boundaries and validates it; a text without anchors costs nothing more. The four base kinds equal
leftmost non-overlapping matching of their patterns; url and account are additional kinds.

Nulls and empty texts have no spans; texts are read whole, however long, in one pass. Rows are independent, so repeated rows repeat their results, and a
table without rows gives none. Of overlapping matches of one kind the leftmost counts; kinds don't hide each other. A caller's columns n_email, n_ip,
n_card, n_phone, base_sha256, spans or _text are not to be kept under these names; rename them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, read

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
DIAL = DIGITS | frozenset(" ().-")
SPACES = frozenset(" \t\n\x0b\x0c\r")
URL_END = SPACES | frozenset("<>\"'`{}|\\^")
KINDS = ("email", "ip", "card", "phone", "account", "url")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("IBAN", "iban", "account", "Account", "acct", "Acct", "SSN", "ssn", "passport", "Passport")

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        digits = sorted(DIGITS)
        patterns = {"@": ("email", 1)} | {f"+{d}": ("phone", 2) for d in digits}
        patterns |= {f"{d}.{e}": ("ip", 3) for d in digits for e in digits}
        patterns |= {f"{d}{s}{e}": ("card", 2 + len(s)) for d in digits for e in digits for s in ("", " ", "-")}
        patterns |= {s: ("url", len(s)) for s in SCHEMES} | {c: ("account", len(c)) for c in CUES}
        for p, v in patterns.items():
            a.add_word(p, v)
        a.make_automaton()
        _automaton = a
    return _automaton


def _forward(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _back(text: str, at: int, least: int, chars: frozenset) -> int:
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def _email(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = _back(text, at, free, LOCAL)
    end = _forward(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = _forward(text, end + 1, LABEL)
        dots += 1
    return (start, end, True) if dots else None


def _ip(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    start = _back(text, at + 1, free, DIGITS)
    if start > at:
        return None
    end, parts = start, []
    while len(parts) < 4:
        to = _forward(text, end, DIGITS)
        if to == end:
            return None
        parts.append(text[end:to].lstrip("0"))
        if len(parts) < 4:
            if to >= len(text) or text[to] != ".":
                return None
            to += 1
        end = to
    return start, end, all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _chain(text: str, at: int) -> int:
    """End of the digits from at on, of which any two may have one space or hyphen between them."""
    n = len(text)
    while True:
        at = _forward(text, at, DIGITS)
        if at + 1 < n and text[at] in " -" and text[at + 1] in DIGITS:
            at += 1
        else:
            return at


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _card(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    if at < free:
        return None
    end = _chain(text, at)
    if end - at < 13:
        return at, end, False
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    run = _forward(text, at + 2, DIAL)
    end = run
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:  # at least one character between the first and the last digit
        return None
    return at, end, 9 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _url(text: str, at: int, free: int) -> tuple[int, int, bool] | None:
    if at < free:
        return None
    n, end = len(text), at
    while end < n and text[end] not in URL_END:
        end += 1
    while end > at and text[end - 1] in ".,;:!?)]":
        end -= 1
    host = text.find(":", at) + 1
    return at, end, end > host + 3


def iban(s: str) -> bool:
    if not (15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    value = 0
    for c in s[4:] + s[:4]:
        v = int(c, 36)
        value = (value * (100 if v > 9 else 10) + v) % 97
    return value == 1


def _account(text: str, end: int, free: int) -> tuple[int, int, bool] | None:
    """After a cue, within 12 characters of separators: an IBAN, or a number of 6 to 17 digits."""
    at = end
    while at < len(text) and at < end + 12 and text[at] not in LETTERS and text[at] not in DIGITS:
        at += 1
    if at < free or at >= len(text) or at == end:
        return None
    if text[at] in LETTERS:
        to, s = at, ""
        while to < len(text) and len(s) < 34 and (text[to] in LABEL and text[to] != "-" or text[to] == " " and to + 1 < len(text) and text[to + 1] in DIGITS | LETTERS):
            s += text[to].upper() * (text[to] != " ")
            to += 1
            if iban(s) and (to >= len(text) or text[to] not in LETTERS | DIGITS):
                return at, to, True
        return None
    to = _chain(text, at)
    return at, to, 6 <= sum(c in DIGITS for c in text[at:to]) <= 17


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in order, in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in automaton().iter(text):
        first = last - n + 1
        if first < free[kind]:
            # an ip may start with the digits that are left of an anchor's first one, an address right after another
            if kind != "email":
                continue
        if kind == "email":
            hit = _email(text, first, free[kind])
        elif kind == "ip":
            hit = _ip(text, first, free[kind])
        elif kind == "card":
            if first > free[kind] and text[first - 1] in DIGITS:
                first = _back(text, first, free[kind], DIGITS)
            hit = _card(text, first, free[kind])
        elif kind == "phone":
            hit = _phone(text, first, free[kind])
        elif kind == "url":
            hit = _url(text, first, free[kind])
        else:
            hit = _account(text, last + 1, free[kind])
        if hit:
            free[kind] = hit[1]
            if hit[2]:
                found[kind].append((hit[0], hit[1]))
    return found


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("_text")
        starts, out = [], {k: [] for k in ("ns", "base", "all")}
        for text in b.column(at):
            found = spans(text.as_py())
            names = [f"{k}:{s}:{e}" for k in KINDS for s, e in found[k]]
            n_base = sum(len(found[k]) for k in BASE)
            out["ns"].append([len(found[k]) for k in BASE])
            out["base"].append(hashlib.sha256(",".join(names[:n_base]).encode()).hexdigest())
            out["all"].append(",".join(names))
        starts = list(zip(*out["ns"], strict=True)) if out["ns"] else [[]] * 4
        cols = [c for i, c in enumerate(b.columns) if i != at]
        names = [n for i, n in enumerate(b.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*cols, *(pa.array(c, pa.int64()) for c in starts), pa.array(out["base"], pa.string()), pa.array(out["all"], pa.string())],
            names=[*names, *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )


def find(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, counts of the base kinds, the digest of base spans, and all spans as kind:start:end."""
    text = F.col(text) if isinstance(text, str) else text
    src = docs.select(*keep, text.alias("_text"))
    return src.mapInArrow(_digest, extended(src, ", ".join([*(f"n_{k} bigint" for k in BASE), "base_sha256 string", "spans string"])))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


QUERIES = {"op9_pii": op9_pii}
ORACLE_SQL: dict[str, str] = {}
