"""Matching two tables on equivalence keys, and merging them with every left-over accounted for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.email import parse_email
from tablemill.functions.text import collapsed, let, normal, trimmed, without_marks

KINDS = ("exact", "loose", "unaccented", "digits", "name_parts", "email_name")
#: Status of a merged row, in its sort order. Fixed values.
HIT, SEVERAL, NONE, ONLY_RIGHT = "träff", "flera träffar", "ingen träff", "bara i den andra filen"
STATUS_ORDER = (HIT, SEVERAL, NONE, ONLY_RIGHT)
#: Headers that mean the same, by group. Fixed values.
SYNONYMS = (
    ("namn", "name", "fullname", "kund", "customer", "kundnamn", "customername"),
    ("epost", "email", "mail", "emailaddress", "epostadress"),
    ("telefon", "phone", "tel", "mobil", "mobile"),
    ("ort", "city", "stad", "postort"),
    ("postnr", "postnummer", "zip", "zipcode", "postalcode"),
    ("kundnr", "kundnummer", "customerid", "customernumber"),
    ("land", "country"),
    ("adress", "address", "gatuadress", "street"),
    ("foretag", "company", "organisation", "org"),
)
#: A looser kind within this share of the best score gives way to the stricter one.
NEAR = 0.95


@dataclass
class Pair:
    left: str
    right: str
    kind: str = "loose"
    right_second: str | None = None


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def match_key(c: Column, kind: str) -> Column:
    """The key of a match kind; empty where the value can't take part."""
    v = trimmed(normal(c))
    plain = lambda x: F.lower(without_marks(x))
    if kind == "exact":
        return v
    if kind == "loose":
        return F.lower(collapsed(v))
    if kind == "unaccented":
        return plain(collapsed(v))
    if kind == "digits":
        return F.regexp_replace(v, r"\D", "")
    if kind in ("name_parts", "email_name"):
        return let(plain(collapsed(v)), lambda k: F.array_join(F.array_sort(F.filter(F.split(k, r"[\s,]+"), lambda p: p != "")), " "))
    raise ValueError(kind)


def _keys(pair: Pair) -> tuple[Column, Column]:
    """Left and right key expressions of a column pair."""
    if pair.kind == "name_parts":
        first, last = trimmed(normal(_text(pair.right))), trimmed(normal(_text(pair.right_second)))
        both = F.when((first != "") & (last != ""), F.concat_ws(" ", first, last)).otherwise("")
        return match_key(_text(pair.left), "name_parts"), match_key(both, "name_parts")
    if pair.kind == "email_name":
        p = parse_email(_text(pair.left))
        return match_key(F.coalesce(F.concat_ws(" ", p["first"], p["last"]), F.lit("")), "email_name"), match_key(_text(pair.right), "email_name")
    return match_key(_text(pair.left), pair.kind), match_key(_text(pair.right), pair.kind)


def keyed(df: DataFrame, pairs: list[Pair], side: int, row: str) -> tuple[DataFrame, list[str]]:
    """(row, keys) of rows whose keys are all filled; a composite key is a list of columns, not a text."""
    names = [f"_m{i}" for i in range(len(pairs))]
    out = df.select(F.col(row), *[_keys(p)[side].alias(n) for n, p in zip(names, pairs, strict=True)])
    return out.filter(reduce(lambda a, b: a & b, [F.col(n) != "" for n in names])), names


def match(left: DataFrame, right: DataFrame, pairs: list[Pair], left_row: str, right_row: str) -> DataFrame:
    """(left_row, right_row): all pairs of rows with equal keys; ids are named _l and _r."""
    a, names = keyed(left, pairs, 0, left_row)
    b, _ = keyed(right, pairs, 1, right_row)
    return a.withColumnRenamed(left_row, "_l").join(b.withColumnRenamed(right_row, "_r"), names).select("_l", "_r")


def add_pairs(found: DataFrame, more: DataFrame) -> DataFrame:
    """Hand-made pairs join the found ones once each."""
    return found.unionByName(more).dropDuplicates(["_l", "_r"])


def match_stats(left: DataFrame, right: DataFrame, pairs: list[Pair], left_row: str, right_row: str) -> DataFrame:
    """One row: matched, unmatched, several and empty keys of both sides, and the largest fan-out.

    Counted from key counts of each side, so a frequent key costs one row, not its pairs.
    """
    a, names = keyed(left, pairs, 0, left_row)
    b, _ = keyed(right, pairs, 1, right_row)
    counts = a.groupBy(*names).agg(F.count("*").alias("l")).join(b.groupBy(*names).agg(F.count("*").alias("r")), names, "full")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))  # noqa: E741
    both = (l > 0) & (r > 0)
    used = counts.agg(
        F.coalesce(F.sum(F.when(both, l)), F.lit(0)).alias("matched_left"),
        F.coalesce(F.sum(F.when(both, r)), F.lit(0)).alias("matched_right"),
        F.coalesce(F.sum(F.when(both & (r > 1), l)), F.lit(0)).alias("several_left"),
        F.coalesce(F.sum(F.when(both & (l > 1), r)), F.lit(0)).alias("several_right"),
        F.coalesce(F.max(F.when(both, r)), F.lit(0)).alias("largest_fan_out"),
        F.coalesce(F.sum(F.when(both, l * r)), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum(l), F.lit(0)).alias("keyed_left"),
        F.coalesce(F.sum(r), F.lit(0)).alias("keyed_right"),
    )
    sizes = left.agg(F.count("*").alias("n_left")).crossJoin(right.agg(F.count("*").alias("n_right")))
    return used.crossJoin(sizes).select(
        "n_pairs", "matched_left", "matched_right", (F.col("n_left") - F.col("matched_left")).alias("unmatched_left"), (F.col("n_right") - F.col("matched_right")).alias("unmatched_right"),
        "several_left", "several_right", (F.col("n_left") - F.col("keyed_left")).alias("empty_left"), (F.col("n_right") - F.col("keyed_right")).alias("empty_right"), "largest_fan_out",
    )


def rest(df: DataFrame, other: DataFrame, pairs: list[Pair], row: str, other_row: str, side: int = 0, written_off: list | None = None) -> DataFrame:
    """Rows of one side without a match, less those that were written off."""
    own, names = keyed(df, pairs, side, row)
    theirs, _ = keyed(other, pairs, 1 - side, other_row)
    out = df.join(own.join(theirs.select(*names).distinct(), names, "left_semi").select(row), row, "left_anti")
    return out.filter(~F.col(row).isin(written_off)) if written_off else out


def ambiguous(left: DataFrame, right: DataFrame, pairs: list[Pair], left_row: str, right_row: str) -> DataFrame:
    """Left rows with several matches."""
    a, names = keyed(left, pairs, 0, left_row)
    b, _ = keyed(right, pairs, 1, right_row)
    many = b.groupBy(*names).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return left.join(a.join(many, names, "left_semi").select(left_row), left_row, "left_semi")


def unique_name(name: str, taken: set[str]) -> str:
    """name, or name (2), (3) ... if it is taken in any case."""
    out, k = name, 2
    while out.lower() in taken:
        out, k = f"{name} ({k})", k + 1
    taken.add(out.lower())
    return out


def merge(
    left: DataFrame, right: DataFrame, pairs: list[Pair], left_row: str, right_row: str, columns: list[str], several: str = "first", both: bool = False, prefix: str = "", status: str = "Träff"
) -> DataFrame:
    """left's columns, the chosen columns of right, and the status.

    several: 'first' takes the lowest right row, 'duplicate' a row for each match, 'leave' none but
    says so. both: right rows without a match follow, with nulls on the left. Only key counts and
    one value struct by key meet the left side unless rows are to be duplicated.
    """
    taken = {c.lower() for c in left.columns}
    names = {c: unique_name(f"{prefix}{c}", taken) for c in columns}
    status = unique_name(status, taken)
    keys = [f"_m{i}" for i in range(len(pairs))]
    usable = lambda: reduce(lambda x, y: x & y, [F.col(k) != "" for k in keys])
    a = left.withColumns({k: _keys(p)[0] for k, p in zip(keys, pairs, strict=True)})
    a = a.withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in keys})
    b = right.withColumns({k: _keys(p)[1] for k, p in zip(keys, pairs, strict=True)}).filter(usable())
    values = F.struct(F.col(right_row).alias("_r"), *[F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(columns)])
    counts = b.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(values).alias("_x"))
    if several == "duplicate":
        counts = b.select(*keys, values.alias("_x")).join(counts.select(*keys, "_n"), keys)
    found = a.join(counts, keys, "left")
    given = F.col("_n").isNotNull() if several != "leave" else F.col("_n") == 1
    label = F.when(F.col("_n").isNull(), NONE).when(F.col("_n") > 1, SEVERAL).otherwise(HIT)
    out = found.select(*left.columns, *[F.when(given, F.col(f"_x._v{i}")).alias(names[c]) for i, c in enumerate(columns)], label.alias(status))
    if both:
        extra = rest(right, left, pairs, right_row, left_row, 1)
        out = out.unionByName(extra.select(*[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in left.columns], *[F.col(f"`{c}`").alias(names[c]) for c in columns], F.lit(ONLY_RIGHT).alias(status)))
    return out


def preview_sample(merged: DataFrame, status: str, order: str, size: int) -> DataFrame:
    """A proportional sample by status with at least one row of each that exists."""
    counts = merged.groupBy(status).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    quota = counts.crossJoin(F.broadcast(total)).select(status, F.greatest(F.lit(1), F.floor(F.col("_n") * size / F.col("_all"))).alias("_q"))
    ranked = merged.withColumn("_k", F.row_number().over(Window.partitionBy(status).orderBy(order)))
    return ranked.filter(F.col("_k") <= size).join(F.broadcast(quota), status).filter("_k <= _q").drop("_k", "_q")


def header_key(name: str) -> str:
    """A header for comparison: no case, accents or punctuation."""
    import re
    import unicodedata

    return re.sub("[^a-z0-9]", "", "".join(x for x in unicodedata.normalize("NFD", name) if not "\u0300" <= x <= "\u036f").lower())


def synonym_group(name: str) -> int:
    key = header_key(name)
    return next((i for i, g in enumerate(SYNONYMS) if key in g), -1)


def find_alias(name: str, columns: list[str], taken: set[str] = frozenset()) -> str | None:
    """The column that a header means: an equal header first, then one of the same synonyms."""
    free = [c for c in columns if c not in taken]
    if not header_key(name):
        return None
    same = next((c for c in free if header_key(c) == header_key(name)), None)
    group = synonym_group(name)
    return same or (next((c for c in free if synonym_group(c) == group), None) if group >= 0 else None)


def pair_scores(left: DataFrame, right: DataFrame, kinds: tuple[str, ...] = ("exact", "loose", "unaccented")) -> DataFrame:
    """(left_column, right_column, kind, hits, several, score) of all column pairs with a hit.

    Both sides become (column, kind, key, count) first, so the join meets each distinct key once.
    score is the sum over keys of left count / right count.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias(name), F.lit(k).alias("kind"), match_key(_text(c), k).alias("key")) for c in df.columns for k in kinds]
        return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("key <> ''").groupBy(name, "kind", "key").agg(F.count("*").alias(f"n_{name}"))

    a, b = counted(left, "left_column"), counted(right, "right_column")
    return a.join(b, ["kind", "key"]).groupBy("left_column", "right_column", "kind").agg(
        F.sum("n_left_column").alias("hits"),
        F.coalesce(F.sum(F.when(F.col("n_right_column") > 1, F.col("n_left_column"))), F.lit(0)).alias("several"),
        F.sum(F.col("n_left_column") / F.col("n_right_column")).alias("score"),
    )


def suggest_pair(scores: list[dict]) -> tuple[dict | None, str]:
    """The best of pair_scores() rows and why: 'name', 'most', or None with 'no_hit'."""
    strict = {k: i for i, k in enumerate(KINDS)}
    if not scores:
        return None, "no_hit"
    top = max(x["score"] for x in scores)
    near = [x for x in scores if x["score"] >= NEAR * top]
    named = [x for x in near if header_key(x["left_column"]) == header_key(x["right_column"])]
    named = named or [x for x in near if (g := synonym_group(x["left_column"])) >= 0 and g == synonym_group(x["right_column"])]
    pool, why = (named, "name") if named else (near, "most")
    return min(pool, key=lambda x: (strict[x["kind"]], -x["score"], x["left_column"], x["right_column"])), why


def difference_span(a: str, b: str) -> tuple[int, int, int, int]:
    """[start, end) in both keys of what lies between their common prefix and suffix."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return start, len(a) - tail, start, len(b) - tail


def match_rounds(left: DataFrame, right: DataFrame, rounds: list[list[Pair]], left_row: str, right_row: str) -> DataFrame:
    """Each round matches what the rounds before left over; (_l, _r, round)."""
    out, a, b = None, left, right
    for k, pairs in enumerate(rounds):
        found = match(a, b, pairs, left_row, right_row).withColumn("round", F.lit(k))
        out = found if out is None else out.unionByName(found)
        a, b = rest(a, b, pairs, left_row, right_row), rest(b, a, pairs, right_row, left_row, 1)
    return out
