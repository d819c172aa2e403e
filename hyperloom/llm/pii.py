"""Personal data with offsets in the source text, disguised forms included.

Plain forms are found in the text itself. Then transducers rewrite the text: look-alike characters to ASCII,
invisible characters to nothing, at and dot disguises to ``@`` and ``.``, spelled digits to digits. Every
character that comes out carries the span of the source that it came from. Identifiers found in the rewritten text are mapped
back by these spans; those that touch a plain one add nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, pieces

KINDS = ("email", "ip", "card", "phone")

# ---- plain forms

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: The look-behind spares later starts in the same run of digits, which can't match where the first doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _ip_ok(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in s.split("."))


def emails(text: str):
    """Leftmost non-overlapping matches: grown to the left and right of each ``@``, so no run is read twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain forms, by start, then kind as listed in KINDS."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if _ip_ok(m.group())]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if _card_ok(m.group())]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- transducers

#: Letters of other scripts that look like ASCII (fixed values: Cyrillic, then Greek).
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhlABEKMHOPCTYXIJS")) | dict(zip("ονρυικταΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpuiktaABEZHIKMNOPTYX"))
LOOKALIKES |= {"․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "–": "-", "ⓐ": "@"}
_INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Spelled digits of four languages (fixed values).
DIGIT_WORDS = {
    "0": "zero oh null zéro cero", "1": "one eins un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_VALUE = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
_WORD = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_AT_WORD, _DOT_WORD = r"(?:at|ät|arroba|arobase)", r"(?:dot|punkt|point|punto)"
#: Five spelled digits at least, perhaps after a plus, with digits between them.
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\s-]+)?(?:(?:{_WORD}|[0-9])(?![^\W\d_])[\s,.()-]*(?:{_DOT_WORD}\s+)?){{5,}}", re.IGNORECASE)
#: A run worth rewriting holds one of these; the others are articles and particles as well.
_TELLING = frozenset(_VALUE) - {"un", "une", "uno", "oh", "null", "dos"}
_SPELLED_PART = re.compile(rf"(?P<plus>plus[\s-]+)|(?P<word>{_WORD})(?![^\W\d_])|(?P<dot>[\s]*(?<![^\W_]){_DOT_WORD}(?![^\W_])\s*)", re.IGNORECASE)
_SPELLED_DIGIT = re.compile(rf"(?<![^\W_]){_WORD}(?![^\W_])", re.IGNORECASE)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"(?:\s*{_OPEN}\s*(?:{_AT_WORD}|@)\s*{_CLOSE}\s*|\s*@\s*)"
_DOT = rf"(?:\s*{_OPEN}\s*(?:{_DOT_WORD}|\.)\s*{_CLOSE}\s*|\s+{_DOT_WORD}\s+|\s\.\s|\.)"
_NAME, _LABEL = r"[A-Za-z0-9._%+-]+", r"[A-Za-z0-9-]+"
#: A name starts where a run of its characters starts and takes the whole run, so long runs are read once; dots inside may be disguised.
_FROM = r"(?<![A-Za-z0-9._%+-])"
_MARKED_DOT = rf"\s*{_OPEN}\s*(?:{_DOT_WORD}|\.)\s*{_CLOSE}\s*"
_NAMES = rf"{_FROM}(?P<name>{_NAME}+(?:(?:\s+{_DOT_WORD}\s+|{_MARKED_DOT}){_NAME}+){{0,3}})"
#: name AT label (DOT label)+ with marked disguises, or with the bare words for at and for every dot.
_ADDRESS = re.compile(rf"{_NAMES}(?P<at>{_AT})(?P<host>{_LABEL}(?:{_DOT}{_LABEL})+)", re.IGNORECASE)
#: Last labels that bare words may lead to (fixed values): some endings of three letters and more, and after the word dot any of two letters that are no
#: common word; "at the point of" is no address.
_LONG_ENDS = "com|org|net|edu|gov|info|biz|example|test|dev|app"
_NO_ENDS = "an|as|by|do|go|he|if|my|of|on|or|so|to|up|we"
_ENDS = rf"(?:{_LONG_ENDS}|(?!(?:{_NO_ENDS})(?![^\W_]))[a-z][a-z])"
_BARE = re.compile(rf"{_NAMES}(?P<at>\s+{_AT_WORD}\s+)(?P<host>{_LABEL}(?:\s+{_DOT_WORD}\s+{_LABEL})*\s+{_DOT_WORD}\s+{_ENDS})(?![^\W_])", re.IGNORECASE)
#: A name with a mark or digit inside, the bare word for at, and a plain host: "j.smith at example.com", but not "meet us at example.com".
_AT_HOST = re.compile(rf"{_FROM}(?P<name>(?=[A-Za-z0-9%+-]*[._0-9])(?=[0-9._%+-]*[A-Za-z]){_NAME}+)(?P<at>\s+{_AT_WORD}\s+)(?P<host>{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}})(?![A-Za-z0-9])", re.IGNORECASE)
_DOT_INSIDE = re.compile(_DOT, re.IGNORECASE)
_MARK = re.compile(rf"{_OPEN}\s*(?:{_AT_WORD}|@|{_DOT_WORD}|\.)\s*{_CLOSE}", re.IGNORECASE)
#: Numbers joined by marked or spelled dots.
_NUMBERS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_ODD = re.compile(r"[­·Ͱ-֏٠-ٯ۰-۹ऀ-෿ᴀ-ᶿ -⯿　-〿Ꙁ-ꚟ︀-﻿＀-￯\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff]")
_HINTS = ("dot", "punkt", "point", "punto", "arroba", "arobase")
#: A word for at, then a plain host, in lower case.
_AT_HINT = re.compile(rf"\s{_AT_WORD}\s+[a-z0-9-]+\.[a-z0-9]")


class Mapped:
    """A text whose characters carry the span of the source that they come from."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace (from, to, by) parts, in order and apart; each new character stands for the whole part."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        return Mapped("".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:])


def _plain_letter(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    flat = unicodedata.normalize("NFKC", c)
    return flat if flat.isascii() and len(flat) == 1 and flat.isprintable() else c


def letters(m: Mapped) -> Mapped:
    """Look-alikes to ASCII, but only in words that hold ASCII, a digit or a mark besides; invisible characters to nothing."""
    edits = []
    for x in _ODD.finditer(m.text):
        new = _plain_letter(x.group())
        if new != x.group():
            edits.append((*x.span(), new))
    return m.rewrite(edits)


def spelled(m: Mapped) -> Mapped:
    """Runs of spelled digits to digits, a leading plus word to its sign, spelled dots inside to dots."""
    edits = []
    for run in _SPELLED.finditer(m.text):
        if len(_SPELLED_DIGIT.findall(run.group())) < 3:
            continue
        parts = list(_SPELLED_PART.finditer(m.text, *run.span()))
        dotted = any(x["dot"] for x in parts)
        for i, x in enumerate(parts):
            new = "+" if x["plus"] else "." if x["dot"] else _VALUE[x["word"].lower()]
            edits.append((*x.span(), new))
            if dotted and i + 1 < len(parts) and x["word"] and parts[i + 1]["word"] and m.text[x.end() : parts[i + 1].start()].isspace():
                edits.append((x.end(), parts[i + 1].start(), ""))
    return m.rewrite(edits)


def addresses(m: Mapped) -> Mapped:
    """at and dot disguises to their signs, inside what reads as an address, and inside four joined numbers."""
    edits = []
    for pattern in (_ADDRESS, _BARE, _AT_HOST):
        for x in pattern.finditer(m.text):
            edits.append((*x.span("at"), "@"))
            for part in ("name", "host"):
                edits += [(*d.span(), ".") for d in _DOT_INSIDE.finditer(m.text, *x.span(part))]
    for x in _NUMBERS.finditer(m.text):
        edits += [(*d.span(), ".") for d in _DOT_INSIDE.finditer(m.text, *x.span())]
    apart, at = [], 0
    for e in sorted(set(edits)):
        if e[0] >= at:
            apart.append(e)
            at = e[1]
    return m.rewrite(apart)


class Covered:
    """Which parts of a text spans cover, for one lookup each."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a), self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        at = bisect_right(self.ends, a)  # the first part that ends after a
        return at < len(self.starts) and self.starts[at] < b


def added_spans(text: str, plain: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source of identifiers that only the rewritten text shows."""
    low = text.lower()
    odd = not text.isascii() and _ODD.search(text) is not None
    words = not _TELLING.isdisjoint(low.replace(",", " ").replace(".", " ").replace("-", " ").replace("(", " ").replace(")", " ").split())
    marks = any(h in low for h in _HINTS) or _AT_HINT.search(low) is not None or _MARK.search(text) is not None or " @ " in text or "@ " in text or " @" in text
    if not (odd or words or marks):
        return []
    m = Mapped(text)
    if odd:
        m = letters(m)
    m = addresses(spelled(m) if words else m)
    if m.text == text:
        return []
    out = []
    found = plain_spans(m.text)
    # A number that was spelled needs no plus sign to be a phone number.
    taken = Covered((a, b) for a, b, _ in found)
    for x in _CARD.finditer(m.text):
        a, b = x.span()
        changed = sum(m.end[i] - m.start[i] > 1 or text[m.start[i]] != m.text[i] for i in range(a, b))
        if changed >= 3 and 9 <= len(_digits(x.group())) <= 15 and not taken.touches(a, b):
            found.append((a, b, "phone"))
    known = Covered((a, b) for a, b, _ in plain)
    for a, b, kind in found:
        s, e = m.start[a], m.end[b - 1]
        if known.touches(s, e):
            continue
        if text[s:e] == m.text[a:b] and kind != "email":
            continue
        out.append((s, e, kind))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(text: str | None) -> tuple[list, list]:
    """(plain spans, all spans) of a text; null: none."""
    plain = plain_spans(text or "")
    more = added_spans(text, plain) if text else []
    return plain, sorted(plain + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in angle brackets; overlapping ones count as the first."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find(text)[1]:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_FIELDS = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain forms), base_sha256, spans (all), n_added.

    Null and empty texts have no spans. Rows that repeat return a row each; other columns are not read.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts, rows = column(b, "text"), []
            for t in texts:
                plain, spans = find(t)
                n = [sum(k == s[2] for s in plain) for k in KINDS] if plain else [0] * 4
                rows.append((*n, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(spans), len(spans) - len(plain)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=_FIELDS)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with identifiers in text replaced; every row and column stays, n_chars follows the text where there is one."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            new, texts = [], column(b, "text")
            for x, y in pieces(texts):
                new += [redact(t) for t in texts[x:y]]
            yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
