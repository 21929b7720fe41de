"""Bytes to text: encoding by marks, patterns and error rates, with a self-check for broken text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tablemill.functions.text import repair_text

MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: UTF-8 stands up to so many bad sequences, and to this share of the non-ASCII bytes. Fixed values.
BAD_COUNT, BAD_SHARE = 8, 0.0005
_HIGH = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xC0))
BROKEN = re.compile(f"[ÃÂ][{re.escape(_HIGH)}]")
PLAIN = re.compile(r"[^\x00-\x7f]")
SAMPLES = 5


@dataclass
class Decoded:
    text: str
    encoding: str
    mark: bool
    bad: int
    newline: str
    state: str
    samples: list[str] = field(default_factory=list)
    repairable: bool = False


def wide_guess(data: bytes) -> str | None:
    """UTF-16 without a mark, by where the zero bytes fall in the first 2 KB."""
    head = data[:2048]
    if len(head) < 16:
        return None
    half, even, odd = len(head) / 2, head[::2].count(0), head[1::2].count(0)
    if odd > 0.6 * half and even < 0.1 * half:
        return "utf-16-le"
    return "utf-16-be" if even > 0.6 * half and odd < 0.1 * half else None


def dominant_newline(text: str) -> str:
    head = text[:200_000]
    pairs = head.count("\r\n")
    return "\r\n" if pairs >= head.count("\n") - pairs else "\n"


def samples(text: str, pattern: re.Pattern) -> list[str]:
    out = []
    for m in pattern.finditer(text):
        out.append(re.sub(r"[\r\n]+", " ", text[max(0, m.start() - 12) : m.start() + 14]).strip())
        if len(out) == SAMPLES:
            break
    return out


def encoding_of(data: bytes) -> tuple[str, int]:
    """(encoding, length of the byte order mark)."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, len(mark)
    if name := wide_guess(data):
        return name, 0
    bad = data.decode("utf-8", "replace").count("�")
    high = sum(b > 127 for b in data) if bad else 0
    return ("utf-8" if bad <= BAD_COUNT and bad <= BAD_SHARE * high or not bad else "cp1252"), 0


def decode_bytes(data: bytes, forced: str | None = None) -> Decoded:
    """Text of a file with what was found out about it."""
    encoding, mark = encoding_of(data)
    encoding = forced or encoding
    text = data[mark:].decode(encoding, "replace")
    broken = samples(text, BROKEN)
    if broken:
        state, shown, fixable = "mojibake", broken, repair_text(text) is not None
    else:
        shown, fixable = samples(text, PLAIN), False
        state = "ok" if shown else "unknown"
    return Decoded(text, encoding, bool(mark), text.count("�"), dominant_newline(text), state, shown, fixable)


def unencodable(text: str, encoding: str = "cp1252") -> list[str]:
    """Distinct characters that an encoding would lose."""
    return sorted({c for c in text if not c.encode(encoding, "ignore")})
