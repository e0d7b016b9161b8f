"""Personal data by offset-preserving deobfuscation.

Plain identifiers are found in the source text itself.  Then transducers rewrite
what disguises them: look-alike characters become the ASCII characters they
imitate, invisible characters vanish, spelled digits become digits, `[at]`,
`(dot)` and their kin become `@` and `.`.  Each output character keeps the span
of source characters it came from, the same detectors run over the output, and
what they find is mapped back to source offsets.  Spans that touch no plain span
of their kind are added; plain spans always stay.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters.
_ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "．": ".",
}
# Characters that are not seen.
_UNSEEN = "­​‌‍⁠﻿"
# The ten digits as words, in four languages.
_SPELLED = (
    ("zero", "oh", "null", "cero", "zéro"),
    ("one", "eins", "uno"),
    ("two", "zwei", "dos", "deux"),
    ("three", "drei", "tres", "trois"),
    ("four", "vier", "cuatro", "quatre"),
    ("five", "fünf", "cinco", "cinq"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "siete", "sept"),
    ("eight", "acht", "ocho", "huit"),
    ("nine", "neun", "nueve", "neuf"),
)
_DIGIT = {word: str(digit) for digit, words in enumerate(_SPELLED) for word in words}
_WORD = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_RUN = rf"\b{_WORD}(?:[\s,-]{{1,3}}(?:{_WORD}|[0-9])\b)+"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DISGUISE = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}\s{{0,3}}(?:at|arroba|@)\s{{0,3}}{_CLOSE}\s{{0,3}}"
    rf"|(?<=[A-Za-z0-9])\s{{1,3}}(?:at|arroba)\s{{1,3}}(?=[A-Za-z0-9-]{{1,63}}\s{{0,3}}(?:{_OPEN}\s{{0,3}})?(?:dot|punkt|punto|point)\b))"
    rf"|(?P<dot>\s{{0,3}}{_OPEN}\s{{0,3}}(?:dot|punkt|punto|point|\.)\s{{0,3}}{_CLOSE}\s{{0,3}}|(?<=[A-Za-z0-9])\s{{1,3}}(?:dot|punkt|punto)\s{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus\s{{1,3}}(?=[0-9]|{_WORD}\b))|(?P<digits>{_RUN})|(?P<none>[{_UNSEEN}])",
    re.IGNORECASE,
)
_PART = re.compile(rf"{_WORD}|[0-9]", re.IGNORECASE)


_BRACKETED = re.compile(rf"{_OPEN}\s{{0,3}}(?:at|arroba|@|dot|punkt|punto|point|\.)\s{{0,3}}{_CLOSE}", re.IGNORECASE)
_WORDED = re.compile(rf"\s(?:dot|punkt|punto)\s|\s(?:at|arroba)\s{{1,3}}[A-Za-z0-9-]{{1,63}}\s{{0,3}}(?:{_OPEN}\s{{0,3}})?(?:dot|punkt|punto|point)\b", re.IGNORECASE)
_PLUS = re.compile(r"\bplus\s", re.IGNORECASE)
_TOKENS = re.compile(r"\w+")


def _disguised(text: str) -> bool:
    """Whether `text` may hold a disguise other than a look-alike character; a cheap look before the transducer runs.

    True wherever _DISGUISE matches: each of its alternatives has a wider look here.
    """
    if any(c in text for c in _UNSEEN):
        return True
    if any(c in text for c in "[({<") and _BRACKETED.search(text):
        return True
    # the four characters beyond lower() that the patterns take for ASCII letters
    low = text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").replace("K", "k").lower()
    if any(w in low for w in ("dot", "punkt", "punto", "point")) and _WORDED.search(text):
        return True
    if "plus" in low and _PLUS.search(text):
        return True
    return not _DIGIT.keys().isdisjoint(_TOKENS.findall(low))


class _Look(dict):
    """Translation table filled on demand: the ASCII character that a character imitates."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        to = _ALIKE.get(char)
        if to is None and code > 0xFF and char not in _UNSEEN:
            plain = unicodedata.normalize("NFKC", char)
            digit = unicodedata.digit(char, None)
            to = plain if len(plain) == 1 and plain.isascii() and not plain.isspace() else str(digit) if digit is not None else None
        self[code] = out = code if to is None else ord(to)
        return out


_LOOK = _Look()


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    odd = digits[-1::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the identifiers in `text`, leftmost and not overlapping within a kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def reveal(text: str) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The text without disguises and its pieces (output start, source start, source end); None if nothing is disguised.

    A piece as long in the output as in the source maps character by
    character; any other maps as a whole.
    """
    try:
        text.encode("latin-1")
        seen = text
    except UnicodeEncodeError:
        seen = text.translate(_LOOK)
    out, pieces, at, size = [], [], 0, 0

    def put(what: str, start: int, end: int) -> None:
        nonlocal size
        if what or end > start:
            pieces.append((size, start, end))
            out.append(what)
            size += len(what)

    for m in _DISGUISE.finditer(seen) if _disguised(seen) else ():
        put(seen[at : m.start()], at, m.start())
        if m["digits"]:
            for part in _PART.finditer(m[0]):
                put(_DIGIT.get(part[0].lower(), part[0]), m.start() + part.start(), m.start() + part.end())
        else:
            put("@" if m["at"] else "." if m["dot"] else "+" if m["plus"] else "", m.start(), m.end())
        at = m.end()
    if not pieces and seen == text:
        return None
    put(seen[at:], at, len(seen))
    return "".join(out), pieces


def _source(pieces: list[tuple[int, int, int]], starts: list[int], length: int, at: int) -> tuple[int, int]:
    k = bisect_right(starts, at) - 1
    begin, a, b = pieces[k]
    whole = (starts[k + 1] if k + 1 < len(starts) else length) - begin
    return (a + at - begin, a + at - begin + 1) if whole == b - a else (a, b)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans, of `text`: (start, kind's number, end), sorted."""
    plain = plain_spans(text)
    shown = reveal(text)
    if shown is None:
        return plain, plain
    clear, pieces = shown
    starts = [p[0] for p in pieces]
    # what is found already in each kind; a span within one of those shows nothing new
    taken = {k: [(a, b) for a, kind, b in plain if kind == k] for k in range(len(KINDS))}
    found = list(plain)
    for a, kind, b in plain_spans(clear):
        start, end = _source(pieces, starts, len(clear), a)[0], _source(pieces, starts, len(clear), b - 1)[1]
        if not any(x <= start and end <= y for x, y in taken[kind]):
            found.append((start, kind, end))
            taken[kind].append((start, end))
    return plain, sorted(found)


_SPAN = "array<struct<kind:string,start:long,end:long>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(found: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id_col, base, spans), one for each row of `docs`: the plain spans and all spans, by start, then kind.

    Offsets count code points, ends are exclusive.  Plain spans always stay; a
    span found behind a disguise is added unless a span of its kind holds all of
    it, so it may overlap a plain one that shows only part of the identifier.
    Not found are identifiers with letters set apart by spaces, and `_at_` and
    `_dot_` within a word.  A null text is empty and has no spans; texts of any
    length are read whole, in time that follows their length; ids may be null,
    repeated or of any type; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [spans(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([_rows(p[k]) for p in pairs], _SPAN_ARROW) for k in (0, 1))], names=["id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, f"id {kind}, base {_SPAN}, spans {_SPAN}", "text")
    return out.withColumnRenamed("id", id_col)


def hide(text: str | None) -> str | None:
    """The text with each found identifier replaced by its kind in brackets; overlapping ones become one, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for start, kind, end in spans(text)[1]:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each identifier in column `text` replaced by `[EMAIL]`, `[IP]`, `[CARD]` or `[PHONE]`; all else stays, nulls too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        return batch.set_column(at, pa.field(text, pa.string()), pa.array([hide(t) for t in batch.column(at).to_pylist()], pa.string()))

    return map_arrow(docs, run, _ddl(docs), text)


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
