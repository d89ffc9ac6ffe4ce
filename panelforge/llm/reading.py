"""Scanned pages as a stream of comparable words, in the order a reader takes.

Lines are put back into columns by their boxes, columns joined in one line are
parted at the wide gap, words broken at a line end are joined, and letters are
folded: case, accents, ligatures and old letter forms away, and letters that
scanning mistakes for each other into one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_GAP = re.compile(r"\s{3,}")
#: Marks that stand for a word broken at the end of a line (fixed values).
BREAKS = "-=\u00ac\u00ad~\u2010\u2011\u2013"
#: Columns begin so many pixels apart at least.
COLUMN_GAP = 80
_DROP = re.compile(r"[^\w\s]+|_+")
_SPLIT = re.compile(r"[\u2014\u2013]+|\s-+\s")

#: Letters scanning mistakes for each other share a class (fixed values).
_CLASSES = ["ceoa0", "bh8", "nu", "sft5", "rvy", "li1jd", "gq9"]
_FOLD = {ord(c): k[0] for k in _CLASSES for c in k}
#: Letters that decomposition leaves whole (fixed values).
_FORMS = {"\u017f": "s", "\u00df": "ss", "\u00e6": "ae", "\u0153": "oe", "\u00f8": "o", "\u0142": "l", "\u00a6": "i", "\u00a1": "i"}
_PLAIN = {chr(c): "" for c in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xFEFF, 0xFFFD)} | _FORMS
_OTHER = re.compile(r"[^\x00-\x7f]")


def _plain(m: re.Match) -> str:
    return _PLAIN.get(m[0], m[0])


_REPEAT = re.compile(r"(.)\1+")


def reading_order(text: str, xs: list[int | None] | None, ys: list[int | None] | None) -> list[str]:
    """The lines column by column. ``xs``, ``ys``: left and top of each line's box; without one a line, lines keep their order."""
    lines = _LINE.split(text)
    placed = xs is not None and len(xs) == len(lines)
    edges = []
    if placed:
        starts = sorted({x for x in xs if x is not None})
        edges = [b for a, b in zip(starts, starts[1:], strict=False) if b - a > COLUMN_GAP]
    if not edges and "   " not in text and "\t" not in text:
        return lines  # one column, from top to bottom as it stands
    cells = []
    for i, line in enumerate(lines):
        x = xs[i] if placed else None
        y = ys[i] if placed else None
        column = bisect_right(edges, x) if x is not None else 0
        if "  " in line or "\t" in line:
            for k, piece in enumerate(_GAP.split(line.strip())):
                cells.append((column + k, y if y is not None else i, i, piece))
        else:
            cells.append((column, y if y is not None else i, i, line))
    cells.sort()
    return [c[3] for c in cells]


def fold(text: str) -> list[str]:
    """The words of a text, folded."""
    t = text.casefold()
    if not t.isascii():
        t = _OTHER.sub(_plain, unicodedata.normalize("NFKD", t))
    t = t.replace("!", "i").replace("|", "i")
    t = _DROP.sub("", _SPLIT.sub(" ", t))
    t = t.replace("vv", "w").replace("rn", "m").replace("nn", "m").translate(_FOLD)
    return _REPEAT.sub(r"\1", t).split()


def page_words(text: str | None, xs: list[int | None] | None = None, ys: list[int | None] | None = None) -> list[str]:
    """The folded words of a page in reading order; none for a null, empty or blank text."""
    if not text:
        return []
    out = []
    for line in reading_order(text, xs, ys):
        end = line.rstrip()
        if end and end[-1] in BREAKS and (bare := end.rstrip(BREAKS)) and bare[-1].isalnum():
            out.append(bare)
        else:
            out.append(line)
            out.append(" ")
    return fold("".join(out))
