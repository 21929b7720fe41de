"""Recorded workflows: steps as data, replayed on any table with the same headers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions import dates, email, numbers, phone, text
from tablemill.operators import columns, rows
from tablemill.operators.matching import header_key, unique_name

#: Step types that a workflow may hold; unknown ones are dropped when it is read.
STEPS = (
    "clean", "date", "number", "phone", "email", "replace", "split", "template", "formula", "rename",
    "drop_column", "hide_column", "set_type", "drop_empty_rows", "drop_empty_columns", "running_number",
)
DONE, MISSING, REFUSED = "done", "column missing", "refused"


@dataclass
class Report:
    type: str
    outcome: str
    detail: str = ""


@dataclass
class Pipeline:
    steps: list[dict] = field(default_factory=list)

    @staticmethod
    def from_json(data: str) -> Pipeline:
        spec = json.loads(data)
        if spec.get("version") != 1:
            raise ValueError("a workflow of another version")
        return Pipeline([s for s in spec["steps"] if s.get("type") in STEPS])

    def to_json(self) -> str:
        return json.dumps({"version": 1, "steps": self.steps}, ensure_ascii=False)

    def run(self, df: DataFrame) -> DataFrame:
        return self.replay(df)[0]

    def replay(self, df: DataFrame) -> tuple[DataFrame, list[Report]]:
        """All steps as one plan, and what became of each; a step whose column is missing never guesses another."""
        reports = []
        for step in self.steps:
            wanted = [find(df, c) for c in step.get("columns", [])]
            if any(c is None for c in wanted):
                reports.append(Report(step["type"], MISSING, ", ".join(c for c, f in zip(step["columns"], wanted, strict=True) if f is None)))
                continue
            try:
                df = apply(df, step, wanted)
                reports.append(Report(step["type"], DONE))
            except (columns.FormulaError, ValueError) as e:
                reports.append(Report(step["type"], REFUSED, str(e)))
        return df, reports

    def counts(self, df: DataFrame) -> list[tuple[str, int]]:
        """(step type, changed cells) of the rewriting steps, an aggregate a step: only on request."""
        out = []
        for step in self.steps:
            wanted = [find(df, c) for c in step.get("columns", [])]
            if all(wanted):
                try:
                    after = apply(df, step, wanted)
                except (columns.FormulaError, ValueError):
                    continue
                if marked := rewritten(df, step, wanted):
                    n = df.agg(*[F.count_if(~F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).eqNullSafe(x)).alias(c) for c, x in marked.items()]).first()
                    out.append((step["type"], sum(n)))
                df = after
        return out


def find(df: DataFrame, name: str) -> str | None:
    """A visible column by its normalised header."""
    return next((c for c in rows.visible(df).columns if header_key(c) == header_key(name)), None)


def rewritten(df: DataFrame, step: dict, wanted: list[str]) -> dict[str, Column]:
    """Columns that a rewriting step overwrites; empty for other steps."""
    s = {k: v for k, v in step.items() if k not in ("type", "columns", "name")}
    tools = {
        "clean": lambda c: text.CLEANERS[step["cleaner"]](c),
        "date": lambda c: dates.rewrite_date(c, **s),
        "number": lambda c: numbers.rewrite_number(c, **s),
        "phone": lambda c: phone.rewrite_phone(c, **s),
        "replace": lambda c: columns.find_replace(c, **s),
    }
    tool = tools.get(step["type"])
    return {c: tool(columns.text(c)) for c in wanted} if tool else {}


def apply(df: DataFrame, step: dict, wanted: list[str]) -> DataFrame:
    kind = step["type"]
    if made := rewritten(df, step, wanted):
        return df.withColumns(made)
    taken = {c.lower() for c in df.columns}
    if kind == "email":
        field_ = step.get("field", "full")
        return df.withColumn(unique_name(step.get("name", field_), taken), F.coalesce(email.email_field(columns.text(wanted[0]), field_, step.get("surname_first", False)), F.lit("")))
    if kind == "split":
        c = columns.text(wanted[0])
        how = step.get("how", "first")
        if how == "pattern":
            parts = columns.extract_pattern(c, step["pattern"])
            return df.withColumns({unique_name(n, taken): F.coalesce(x, F.lit("")) for n, x in parts.items()})
        parts = {
            "first": lambda: columns.split_first(c, step["delimiter"]), "last": lambda: columns.split_last(c, step["delimiter"]),
            "each": lambda: columns.split_each(c, step["delimiter"], step["parts"]), "position": lambda: columns.split_positions(c, step["positions"]),
        }[how]()
        return df.withColumns({unique_name(f"{wanted[0]} {k}", taken): x for k, x in enumerate(parts, 1)})
    if kind == "template":
        return df.withColumn(unique_name(step["name"], taken), columns.template(df, step["pattern"]))
    if kind == "formula":
        value = columns.formula(df, step["source"], step.get("kinds"))
        return df.withColumn(unique_name(step["name"], taken), F.coalesce(numbers.write_number(value, step.get("comma", True), step.get("decimals")), F.lit("")))
    if kind == "rename":
        return rows.rename_column(df, wanted[0], step["name"])
    if kind == "drop_column":
        return df.drop(*wanted)
    if kind == "hide_column":
        return rows.hide_column(df, wanted[0])
    if kind == "set_type":
        return rows.set_type(df, wanted[0], step["kind"])
    if kind == "drop_empty_rows":
        return rows.drop_empty_rows(df)
    if kind == "drop_empty_columns":
        return rows.drop_empty_columns(df)
    return rows.running_number(df, step["order"], step.get("name", "Nr"))
