"""Cutting texts in pieces quickly, where every character's class is certain.

The cuts of tokenizers speak of letters, numbers and white space in general.
For characters of long-settled blocks these classes are the same in every
version of Unicode, so plain character sets say the same and are much faster
to match.  ``UNCOMMON`` finds any other character; such a text takes the
general way.
"""

from __future__ import annotations

import re
import unicodedata

#: Blocks (first, last) whose characters have kept their class.
SETTLED = [(0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x481), (0x48A, 0x52F), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def _set_of(initial: str) -> str:
    """The settled characters whose category begins with a letter, as a set's ranges."""
    held, runs = [c for a, b in SETTLED for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == initial], []
    for c in held:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


LETTER, NUMBER, BLANK = _set_of("L"), _set_of("N"), r"\t\n\r "
UNCOMMON = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SETTLED) + "]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Byte-level BPE's pieces, blanks included; no alternative can begin where one before it in another order would.
SPACED = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|{ENDINGS}| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Words, single digits and runs of other signs, without blanks.
BARE = re.compile(rf"[{LETTER}]+|[{NUMBER}]|{ENDINGS}|[^{BLANK}{LETTER}{NUMBER}]+")
