"""Stacking files with differing headers into one table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators.matching import find_alias, header_key, synonym_group, unique_name


@dataclass
class Target:
    """A target column: its source column by source number, whether it is included, and a default."""

    name: str
    sources: dict[int, str] = field(default_factory=dict)
    included: bool | None = True
    default: str | None = None


def targets_from_sources(headers: list[list[str]]) -> list[Target]:
    """Targets in file order; each source column binds once, by header or synonym. In all files: included."""
    out: list[Target] = []
    for k, names in enumerate(headers):
        for name in names:
            t = next((t for t in out if k not in t.sources and header_key(t.name) == header_key(name)), None)
            group = synonym_group(name)
            t = t or next((t for t in out if k not in t.sources and group >= 0 and synonym_group(t.name) == group), None)
            if t is None:
                out.append(t := Target(name))
            t.sources[k] = name
    for t in out:
        t.included = True if len(t.sources) == len(headers) else None
    return out


def targets_from_template(template: list[str], headers: list[list[str]]) -> list[Target]:
    """The template's headers in order, always included; other source columns follow undecided."""
    out = [Target(name) for name in template]
    for k, names in enumerate(headers):
        taken: set[str] = set()
        for t in out:
            if t.included and (c := find_alias(t.name, names, taken)):
                t.sources[k] = c
                taken.add(c)
        for name in names:
            if name not in taken:
                t = next((t for t in out if t.included is None and header_key(t.name) == header_key(name)), None)
                if t is None:
                    out.append(t := Target(name, included=None))
                t.sources[k] = name
    return out


def merge_targets(keep: Target, other: Target) -> tuple[Target, Target | None]:
    """keep takes the sources it lacks; what conflicts stays behind in the other."""
    rest = {k: c for k, c in other.sources.items() if k in keep.sources}
    merged = Target(keep.name, keep.sources | {k: c for k, c in other.sources.items() if k not in keep.sources}, keep.included, keep.default)
    return merged, Target(other.name, rest, other.included, other.default) if rest else None


def carry_decisions(old: list[Target], new: list[Target]) -> list[Target]:
    """Decisions on inclusion and defaults survive when the proposal is made anew."""
    known = {t.name: t for t in old}
    for t in new:
        if t.name in known:
            t.included, t.default = known[t.name].included, known[t.name].default
    return new


def stack(frames: list[DataFrame], targets: list[Target], names: list[str] | None = None, order: list[str] | None = None, source: str = "Källa") -> DataFrame:
    """All rows of all frames under the included targets; a default fills only sources without the column.

    With names a source column says where a row comes from; with order columns, row_source and
    row_order keep the order of files and rows without a global sort.
    """
    shown = [t for t in targets if t.included]
    taken = {t.name.lower() for t in shown}
    source = unique_name(source, taken)
    labels: set[str] = set()
    parts = []
    for k, df in enumerate(frames):
        cells = [(F.col(f"`{t.sources[k]}`").cast("string") if k in t.sources else F.lit(t.default or "")).alias(t.name) for t in shown]
        extra = [F.lit(unique_name(names[k], labels)).alias(source)] if names else []
        extra += [F.lit(k).alias("row_source"), F.col(order[k]).alias("row_order")] if order else []
        parts.append(df.select(*[F.coalesce(c, F.lit("")).alias(t.name) for c, t in zip(cells, shown, strict=True)], *extra))
    return reduce(DataFrame.unionByName, parts)


def stack_report(frames: list[DataFrame], targets: list[Target], names: list[str]) -> DataFrame:
    """(source, rows, unfilled): rows of each source and its targets without a column or default."""
    parts = []
    for k, df in enumerate(frames):
        bare = [t.name for t in targets if t.included and k not in t.sources and not t.default]
        parts.append(df.agg(F.count("*").alias("rows")).select(F.lit(names[k]).alias("source"), "rows", F.lit(", ".join(bare)).alias("unfilled")))
    return reduce(DataFrame.unionByName, parts)


def empty_targets(frames: list[DataFrame], targets: list[Target]) -> list[str]:
    """Included targets that would be empty in every row: one aggregate a source, answered before running."""
    filled: set[str] = set()
    for k, df in enumerate(frames):
        own = [t for t in targets if t.included and (k in t.sources or t.default)]
        if own:
            row = df.agg(*[F.max(F.lit(True) if k not in t.sources else F.coalesce(F.col(f"`{t.sources[k]}`").cast("string"), F.lit("")) != "").alias(t.name) for t in own]).first()
            filled |= {t.name for t in own if row[t.name]}
    return [t.name for t in targets if t.included and t.name not in filled]
