"""Text normalisation and cleaners, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are deleted before any comparison, and spaces that count as a plain space. Fixed values.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
HARD_SPACES = "\u00a0\u2007\u202f"
#: White space of the trimming and collapsing rules: Unicode white space and the byte order mark.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = rf"[{WHITE}\x{{FEFF}}]"
_MARKS = r"[\x{0300}-\x{036F}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a one-element array binds it to a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant_map(pairs: dict) -> Column:
    """A map of strings as one constant expression, however many entries it has."""
    return F.map_from_arrays(F.split(F.lit("\t".join(pairs)), "\t"), F.split(F.lit("\t".join(map(str, pairs.values()))), "\t"))


@cache
def _plain_letters() -> tuple[str, str]:
    """Precomposed letters and their base letters, from the Unicode data of the runtime."""
    own, base = [], []
    for k in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(k))
        if len(d) > 1 and all("\u0300" <= x <= "\u036f" for x in d[1:]):
            own.append(chr(k))
            base.append(d[0])
    return "".join(own), "".join(base)


@cache
def _composed() -> dict[str, str]:
    """Base letters with one to three marks to the precomposed letter."""
    found = {}
    for k in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(k))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(k) and all("\u0300" <= x <= "\u036f" for x in d[1:]):
            found[d] = chr(k)
    return found


def nfc(c: Column | str) -> Column:
    """Compose letters with combining marks; other text is returned at the price of one regex test."""
    c = col(c)
    table = constant_map(_composed())
    composed = F.array_join(
        F.transform(F.regexp_extract_all(c, F.lit(rf"(?s).{_MARKS}*"), F.lit(0)), lambda g: F.coalesce(F.try_element_at(table, g), g)), ""
    )
    return F.when(c.rlike(_MARKS), composed).otherwise(c)


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), rf"^{SPACE}+|{SPACE}+$", "")


def normal(c: Column | str) -> Column:
    """What every comparison starts from: NFC, no invisible characters, plain spaces; one search finds out whether any of it is needed."""
    c = col(c)
    return F.when(c.rlike(f"[{HARD_SPACES}{INVISIBLE}{_MARKS[1:]}"), F.translate(nfc(c), HARD_SPACES + INVISIBLE, " " * len(HARD_SPACES))).otherwise(c)


def without_marks(c: Column | str) -> Column:
    """Letters without diacritical marks."""
    own, base = _plain_letters()
    return F.regexp_replace(F.translate(col(c), own, base), _MARKS, "")


def collapsed(c: Column | str) -> Column:
    """One space for each run of white space, none at the ends."""
    return trimmed(F.regexp_replace(col(c), f"[{WHITE}]+", " "))


def normaliser(space: bool = True, marks: bool = False, case: bool = True):
    """The normaliser of duplicates, groups and pivots: each step but the first is an option.

    Plain ASCII with single spaces inside, which one regex search finds out, needs no step but the last.
    """

    def run(c: Column | str) -> Column:
        plain = col(c)
        c = normal(plain)
        c = collapsed(c) if space else c
        c = without_marks(c) if marks else c
        c = F.when(plain.rlike(r"[^\x20-\x7E]" + ("|^ | $|  " if space else "")), c).otherwise(plain)
        return F.lower(c) if case else c

    return run


def search_key(c: Column | str) -> Column:
    """The key of free-text search: without marks and case."""
    c = col(c)
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), without_marks(normal(c))).otherwise(c))


def title(c: Column | str) -> Column:
    """Lower case, then a capital at the start and behind white space, hyphens and apostrophes."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)[\s\-'’]|[^\s\-'’]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def _guarded(f):
    """Empty cells stay as they are."""
    return lambda c: F.when(col(c) == "", col(c)).otherwise(f(col(c)))


#: The text cleaners by name.
CLEANERS = {
    "trim": _guarded(trimmed),
    "collapse": _guarded(lambda c: F.regexp_replace(c, " {2,}", " ")),
    "invisible": _guarded(lambda c: trimmed(normal(c))),
    "upper": _guarded(F.upper),
    "lower": _guarded(F.lower),
    "title": _guarded(title),
}


#: UTF-8 read as Windows-1252 leaves these leads before a character of 0x80-0xBF.
_HIGH = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xC0))
MOJIBAKE = "[ÃÂ][" + "".join(f"\\x{{{ord(x):04X}}}" for x in _HIGH) + "]"


def has_mojibake(c: Column | str) -> Column:
    return col(c).rlike(MOJIBAKE)


def repair_text(text: str) -> str | None:
    """A text read with the wrong encoding, read again; null if it can't be."""
    try:
        return b"".join(x.encode("cp1252") if x.encode("cp1252", "ignore") else bytes([ord(x)]) for x in text).decode("utf-8")
    except (UnicodeError, ValueError):
        return None


def mojibake_repaired(c: Column | str) -> Column:
    """Repaired where the pattern is found and the repair works, else as it is."""

    @F.pandas_udf("string")
    def repaired(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else repair_text(x))

    c = col(c)
    return F.when(has_mojibake(c), F.coalesce(repaired(F.when(has_mojibake(c), c)), c)).otherwise(c)
