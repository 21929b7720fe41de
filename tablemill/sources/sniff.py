"""Delimiter and header row of delimited text, from its first lines."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

#: Candidates in order of preference, and logical lines that are looked at. Fixed values.
DELIMITERS = (";", ",", "\t", "|")
LINES, HEAD_BYTES, CLOSE = 60, 256 * 1024, 0.05


@dataclass
class Sniffed:
    delimiter: str
    header_row: int
    fields: int
    confident: bool
    directive: int = 0


def logical_lines(text: str, limit: int = LINES) -> list[str]:
    """Lines outside quotes; a quoted field may hold line ends."""
    out, start, quoted = [], 0, False
    for m in re.finditer(r'"|\n', text):
        if m.group() == '"':
            quoted = not quoted
        elif not quoted:
            out.append(text[start : m.start()].removesuffix("\r"))
            start = m.end()
            if len(out) == limit:
                return out
    return out + [text[start:]] if start < len(text) else out


def count_fields(line: str, delimiter: str) -> int:
    """Fields of a logical line; delimiters inside quotes don't count."""
    return 1 + re.sub(r'"[^"]*"?', "", line).count(delimiter)


def sniff(text: str) -> Sniffed:
    directive = re.match(r"sep=([;,\t|])\r?\n", text)
    lines = logical_lines(text[directive.end() :] if directive else text)
    filled = [x for x in lines if x.strip()]
    fixed = directive.group(1) if directive else None
    if not filled:
        return Sniffed(fixed or ";", 0, 1, bool(fixed), directive.end() if directive else 0)

    def score(d: str) -> tuple[float, int]:
        counts = Counter(count_fields(x, d) for x in filled)
        fields, hits = max(counts.items(), key=lambda x: (x[1], x[0]))
        return hits / len(filled), fields

    def header(d: str, fields: int) -> int:
        first = next((k for k, x in enumerate(lines) if x.strip()), 0)
        return next((k for k, x in enumerate(lines) if x.strip() and count_fields(x, d) == fields), first)

    if fixed:
        return Sniffed(fixed, header(fixed, score(fixed)[1]), score(fixed)[1], True, directive.end())
    usable = [(d, *score(d)) for d in DELIMITERS if score(d)[1] > 1]
    if not usable:
        return Sniffed(";", header(";", 1), 1, True)
    best = usable[0]
    for x in usable[1:]:
        if x[1] - best[1] > CLOSE or (abs(x[1] - best[1]) <= CLOSE and x[2] > best[2]):
            best = x
    others = [x for x in usable if x is not best]
    sure = best[1] >= 0.9 and all(best[1] - x[1] > CLOSE or best[2] > x[2] for x in others)
    return Sniffed(best[0], header(best[0], best[2]), best[2], sure)


def looks_like_header(rows: list[list[str]]) -> bool:
    """Two rows and columns at least, all filled and distinct, none a number."""
    if len(rows) < 2 or len(rows[0]) < 2:
        return False
    names = [x.strip() for x in rows[0]]
    if any(not x for x in names) or len({x.lower() for x in names}) < len(names):
        return False
    return not any(re.fullmatch(r"[+-]?\d[\d ]*(?:[.,]\d+)?(?:[eE][+-]?\d+)?", x) for x in names)
