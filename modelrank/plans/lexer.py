"""Words of the statement language."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words that mean something; case doesn't matter.
KEYWORDS = frozenset(
    "select rank from where order by asc desc trained tested on classified limit other than chunk budget auto and or not finetuned between is null as distinct "
    "explain json declare print register dataset values finetune with use purge benchmark task change to in".split()
)
TOKEN = re.compile(
    r"""\s*(?:(?P<string>'[^']*'|"[^"]*"|`[^`]*`)|(?P<number>[0-9]+(?:\.[0-9]+)?)(?P<scale>[KMB]\b)?|(?P<word>[A-Za-z][A-Za-z0-9_]*)|(?P<op><>|<=|>=|!=|==|[=<>(),;*.\[\]-]))"""
)
SCALES = {"K": 10**3, "M": 10**6, "B": 10**9}


class StatementError(ValueError):
    """A statement that can't be understood."""


@dataclass(frozen=True)
class Token:
    kind: str  # string, number, name, keyword, op, end
    value: object
    place: int


def tokens(text: str) -> list[Token]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise StatementError(f"what is this: {text[at : at + 20]!r}")
        if m["string"]:
            out.append(Token("string", m["string"][1:-1], at))
        elif m["number"]:
            n = float(m["number"]) if "." in m["number"] else int(m["number"])
            out.append(Token("number", n * SCALES[m["scale"]] if m["scale"] else n, at))
        elif m["word"]:
            low = m["word"].lower()
            out.append(Token("keyword", low, at) if low in KEYWORDS else Token("name", m["word"], at))
        else:
            out.append(Token("op", m["op"], at))
        at = m.end()
    return [*out, Token("end", None, len(text))]
