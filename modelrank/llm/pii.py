"""Personal data, plain and disguised, with offsets into the original text.

The plain kinds (email, ip, card, phone) are patterns over the text as it is,
leftmost and not overlapping, each followed by its test.  For disguised ones a
chain of transducers rewrites the text and keeps, for every character that it
gives out, the stretch of source characters that it came from:

1. characters that look like ASCII letters, digits and signs become those
   (compatibility forms and digits of other scripts by Unicode's own rules,
   look-alike letters by a table), and invisible ones go,
2. runs of spelled digits ("plus one five five five") become digits,
3. "at" and "dot" in brackets, or as words where an address stands around
   them, become the signs.

The same patterns run over the result.  A find that holds a rewritten stretch
is mapped back, and added unless it is equal to or inside a plain find of its
kind; plain finds all stay, also where an added one reaches beyond them.  Null
and empty texts have no spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

KINDS = ("email", "ip", "card", "phone")
#: The plain patterns.  Digits before an address can't begin it anew, so runs are not tried from inside.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = b"0123456789"
#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕԁһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναɡıα", "ABESIJKMHOPCTYXaeopcyxijsdhlqwABEZHIKMNOPTYXovagia"))
INVISIBLE = "\xad​‌‍⁠﻿"
#: Spelled digits and signs.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SIGNS = {"plus": "+", "dot": ".", "point": "."}


def _plain_forms() -> dict[str, str]:
    """Every character beyond Latin-1 that stands for one ASCII character or digit."""
    out = dict(LOOKALIKES)
    for code in range(0x100, 0x20000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        form = str(unicodedata.digit(c)) if kind == "Nd" else unicodedata.normalize("NFKC", c)
        if len(form) == 1 and " " < form < "\x7f":
            out.setdefault(c, form)
    return out | dict.fromkeys(INVISIBLE, "")


PLAIN = _plain_forms()
DISGUISED = re.compile("[" + "".join(map(re.escape, PLAIN)) + "]")
_DIGITS = "|".join(SPELLED)
_GAP = r"[\x20\x09-\x0D-]+"
SPELLED_RUN = re.compile(rf"\b(?:plus{_GAP})?(?:{_DIGITS})(?:{_GAP}(?:{_DIGITS}|dot|point))*{_GAP}(?:{_DIGITS})\b", re.IGNORECASE)
#: Byte by byte: lower case, hyphens to blanks.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 45 else c for c in range(256))
SPELLED_BYTES = frozenset(w.encode() for w in SPELLED)
TOKEN = re.compile(r"[A-Za-z]+")
_LABEL = "[A-Za-z0-9-]+"
_HELD = "[A-Za-z0-9_%+-]++"
_AT = r"\s*(?:\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\}|<\s*at\s*>|\(\s*@\s*\)|\[\s*@\s*\])\s*"
_DOT = r"(?:\s*(?:\(\s*dot\s*\)|\[\s*dot\s*\]|\{\s*dot\s*\}|<\s*dot\s*>|\(\s*\.\s*\)|\[\s*\.\s*\])\s*|[\x20\t]+dot[\x20\t]+)"
#: What follows isn't the rest of a local part: the word "at" before a real address belongs to the sentence.
_ENDS = rf"(?![A-Za-z0-9._%+-]*+@{_LABEL}(?:{_DOT}|\.){_LABEL})"
#: An address is a chain of labels, then a bracketed sign for "at", or words for signs throughout, or a real sign and words for dots; or four numbers.
LABEL = re.compile(rf"(?<![A-Za-z0-9_%+-]){_HELD}", re.IGNORECASE)
NEXT_LABEL = re.compile(rf"(?:{_DOT}|\.)({_HELD})", re.IGNORECASE)
REST = re.compile(rf"{_AT}{_LABEL}+(?:(?:{_DOT}|\.){_LABEL}+)++{_ENDS}|[\x20\t]+at[\x20\t]+{_LABEL}+(?:{_DOT}{_LABEL}+)++{_ENDS}|@{_LABEL}(?:(?:{_DOT}|\.){_LABEL})+", re.IGNORECASE)
NUMBERS = re.compile(rf"[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
SIGN = re.compile(rf"(?P<at>{_AT}|[\x20\t]+at[\x20\t]+)|(?P<dot>{_DOT})", re.IGNORECASE)
BRACKETED = re.compile(r"[(\[{<]\s*(?:at|@|\.)\s*[)\]}>]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _in_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them: from each sign back over the longest run before it, not past the find before."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every plain find, by start and then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    data = text.encode()
    if len(data.translate(None, DIGITS)) < len(data):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(_in_byte(x) for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


class Mapped:
    """A rewritten text: for each character the source stretch and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.made = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put other text in place of some stretches, in order; all of the new text stands for all of the old."""
        if not edits:
            return
        texts, parts, at = [], [[], [], []], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            for held, array, value in zip(parts, (self.start, self.end, self.made), (self.start[a], self.end[b - 1], True)):
                held += [array[at:a], np.full(len(new), value)]
            at = b
        texts.append(self.text[at:])
        self.start, self.end, self.made = (np.concatenate([*held, array[at:]]).astype(array.dtype) for held, array in zip(parts, (self.start, self.end, self.made)))
        self.text = "".join(texts)


def _spelled(match: re.Match) -> Iterator[tuple[int, int, str]]:
    words = [w.lower() for w in TOKEN.findall(match[0])]
    if sum(w in SPELLED for w in words) >= 4:
        yield *match.span(), "".join(SPELLED.get(w) or SIGNS[w] for w in words)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that are addresses once their signs are rewritten, leftmost first.

    What follows a chain of labels doesn't depend on where in it one begins, so
    a label that led nowhere is not walked over again, and every label is walked
    once.
    """
    at, dead = 0, set()
    while m := LABEL.search(text, at):
        start, walked = m.start(), []
        stop = None
        while m:
            label = m.start(m.lastindex or 0)
            if label in dead:
                break
            walked.append(label)
            end = m.end()
            m = NEXT_LABEL.match(text, end)
        else:
            if rest := REST.match(text, end):
                stop = rest.end()
        if stop is None:
            dead.update(walked)
            if numbers := NUMBERS.match(text, start):
                stop = numbers.end()
        if stop is None:
            at = LABEL.match(text, start).end()
        else:
            yield start, stop
            at = stop


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    for a, b in addresses(text):
        for m in SIGN.finditer(text, a, b):
            yield *m.span(), "@" if m["at"] else "."


def hints(text: str) -> tuple[bool, bool, bool]:
    """Whether each transducer may have something to do."""
    data = text.encode()
    folded = data.translate(FOLDED)
    lookalike = False
    if not text.isascii():
        try:
            lookalike = b"\xad" in text.encode("latin-1")
        except UnicodeEncodeError:
            lookalike = DISGUISED.search(text) is not None
    spelled = sum(map(SPELLED_BYTES.__contains__, folded.split())) > 1 and SPELLED_RUN.search(text) is not None
    return lookalike, spelled, b"dot" in folded or BRACKETED.search(text) is not None


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Finds in the rewritten text that hold a rewritten stretch, as source spans."""
    lookalike, spelled, signs = hints(text)
    if not (lookalike or spelled or signs):
        return []
    held = Mapped(text)
    if lookalike:
        held.rewrite([(*m.span(), PLAIN[m[0]]) for m in DISGUISED.finditer(text)])
    if lookalike or spelled:
        held.rewrite([e for m in SPELLED_RUN.finditer(held.text) for e in _spelled(m)])
    if lookalike or signs:
        held.rewrite(list(_signs(held.text)))
    return [(kind, int(held.start[a]), int(held.end[b - 1])) for kind, a, b in plain(held.text) if held.made[a:b].any() or held.end[b - 1] - held.start[a] != b - a]


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain finds, and all finds."""
    text = text or ""
    base = plain(text)
    spans = {kind: [x[1:] for x in base if x[0] == kind] for kind in KINDS}  # in order, none overlaps the next

    def inside(kind: str, a: int, b: int) -> bool:
        at = bisect_right(spans[kind], a, key=lambda x: x[0]) - 1
        return at >= 0 and b <= spans[kind][at][1]

    added = [x for x in disguised(text) if not inside(*x)]
    return base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def pii(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Returns the ``keep`` columns with base and spans: the plain finds, and
    all finds, as arrays of kind, start and end (code points, end exclusive),
    by start and then kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def make():
        def work(texts):
            found = [find(t) for t in texts]
            return [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in one[k]] for one in found], pa.list_(span)) for k in (0, 1)]

        return work

    kind = "array<struct<kind:string,start:long,end:long>>"
    return map_text(df, text, list(keep), f"base {kind}, spans {kind}", make)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    out = pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",") for c in ("base", "spans")}
    # a lambda with two parameters would get the place as the second one
    counts = [F.size(F.filter(F.col("base")["kind"], lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return out.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"))
