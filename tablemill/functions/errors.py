"""What the rewriting tools put where a value can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark of an unreadable value. Fixed value.
INVALID = "OGILTIGT"


def on_failure(c: Column, how: str) -> Column:
    if how not in ("keep", "empty", "mark"):
        raise ValueError(f"on_error is keep, empty or mark, not {how!r}")
    return {"keep": c, "empty": F.lit(""), "mark": F.lit(INVALID)}[how]
