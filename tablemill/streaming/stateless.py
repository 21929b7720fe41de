"""Filters, cleaners and workflows on streams: they hold no state, so a stream runs the same plan.

The table engine itself has no streaming operators; windows, watermarks and late data are not part
of it. Duplicates are the one thing that needs state: they are dropped within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablemill.functions.text import normaliser
from tablemill.operators.filters import Filter, apply_filter
from tablemill.operators.groups import text_of
from tablemill.plans.pipeline import STEPS, Pipeline

#: Steps that need the whole table, which a stream doesn't have.
NEEDS_ALL = ("drop_empty_columns", "running_number")


def filtered(stream: DataFrame, spec: Filter) -> DataFrame:
    return apply_filter(stream, spec)


def replayed(stream: DataFrame, workflow: Pipeline) -> DataFrame:
    bad = [s["type"] for s in workflow.steps if s["type"] in NEEDS_ALL or s["type"] not in STEPS]
    if bad:
        raise ValueError(f"not on a stream: {', '.join(bad)}")
    return workflow.run(stream)


def deduplicated(stream: DataFrame, columns: list[str], time: str, within: str) -> DataFrame:
    """The first row of each normalised key within a watermark."""
    norm = normaliser()
    keys = {f"_k{i}": norm(text_of(stream, c)) for i, c in enumerate(columns)}
    return stream.withColumns(keys).withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys)).drop(*keys)
