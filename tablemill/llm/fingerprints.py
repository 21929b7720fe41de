"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in SQL functions only.

A paragraph is a line; its leaves are runs of up to LEAF characters that end after . ! or ?. A
paragraph's node hashes its leaves' hashes, a section's node its paragraphs' nodes, the root the
sections' nodes (SHA-256 throughout). A paragraph whose node begins with one of the hex digits
below SECTION starts a section, so an edit moves no boundary but its own.

A fingerprint is `root:section;section...`, a section is `node=paragraph,paragraph...`, and a
paragraph is `node-leaf.leaf...`, with nodes and leaves cut to eight hex digits. Equal roots mean
equal texts; where roots differ, the sections, paragraphs and leaves that differ locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import read_table

LEAF = 40
SECTION = "4"
#: Ranges that ids are cut into at most.
RANGES = 4096


def fingerprint(text: str) -> Column:
    """The fingerprint of a string column; of the empty text for null."""
    leaves = f"transform(regexp_extract_all(p, '[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+', 0), x -> sha2(x, 256))"
    return F.expr(
        f"""
        transform(array(transform(transform(split(coalesce({text}, ''), '\\n', -1), p -> {leaves}),
            l -> named_struct('node', sha2(array_join(l, ''), 256), 'leaves', array_join(transform(l, x -> left(x, 8)), '.')))),
        ps -> transform(array(named_struct(
            'nodes', split(substring(array_join(transform(ps, p -> concat(if(p.node < '{SECTION}', ';', ','), p.node)), ''), 2), ';'),
            'short', split(substring(array_join(transform(ps, p -> concat(if(p.node < '{SECTION}', ';', ','), left(p.node, 8), '-', p.leaves)), ''), 2), ';'))),
        s -> transform(array(transform(s.nodes, x -> sha2(x, 256))),
        sections -> concat(sha2(array_join(sections, ''), 256), ':',
            array_join(transform(sections, (x, i) -> concat(left(x, 8), '=', s.short[i])), ';')))[0])[0])[0]
        """
    )


def root(fp: str) -> Column:
    return F.expr(f"left({fp}, 64)")


def likeness(a: str, b: str) -> Column:
    """Twice the leaves that two fingerprints share over the leaves of both; 1 for equal roots."""
    return F.expr(
        f"""
        case when left({a}, 64) = left({b}, 64) then 1D else
        transform(array(named_struct(
            'a', array_distinct(regexp_extract_all({a}, '[-.]([0-9a-f]{{8}})', 1)),
            'b', array_distinct(regexp_extract_all({b}, '[-.]([0-9a-f]{{8}})', 1)))),
        x -> coalesce(try_divide(2D * size(array_intersect(x.a, x.b)), size(x.a) + size(x.b)), 0D))[0] end
        """
    )


def differing_paragraphs(a: str, b: str) -> Column:
    """0-based paragraphs of fingerprint a whose node fingerprint b lacks: only in branches that differ."""
    return F.expr(
        f"""
        case when left({a}, 64) = left({b}, 64) then cast(array() as array<int>) else
        filter(transform(regexp_extract_all({a}, '([0-9a-f]{{8}})-', 1),
            (x, i) -> if(array_contains(regexp_extract_all({b}, '([0-9a-f]{{8}})-', 1), x), null, i)), x -> x is not null) end
        """
    )


def range_bounds(ids: DataFrame) -> list[int]:
    """Ids that cut the documents into ranges of about equal size: as many as shuffle partitions, RANGES at most."""
    k = min(RANGES, max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 100 * k)).first()[0]
    return sorted(set(cuts or []))


def range_of(bounds: list[int]) -> Column:
    """The range of doc_id, by two lookups among at most 64 cuts each."""
    step = 64
    if len(bounds) <= step:
        return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda x: x <= F.col("doc_id"))) if bounds else F.lit(0)
    heads = bounds[::step]
    parts = ", ".join(f"array({', '.join(f'{x}L' for x in bounds[k : k + step])})" for k in range(0, len(bounds), step))
    coarse = f"size(filter(array({', '.join(f'{x}L' for x in heads)}), x -> x <= doc_id))"
    return F.expr(f"transform(array({coarse}), c -> if(c = 0, 0, (c - 1) * {step} + size(filter(array({parts})[c - 1], x -> x <= doc_id))))[0]")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with fingerprint, next_text and next_fingerprint; the next document is the next lower doc_id, after the last the highest.

    The texts are dealt once, by ranges of ids, and a window inside each range finds the next. The
    first document of each range is dealt to the range before it as well (one row a range), so the
    last document there finds it; only the ranges' first ids, RANGES at most, meet in one place.
    """
    ids = docs.select("doc_id").filter("doc_id is not null")
    part = range_of(range_bounds(ids)).cast("int")
    firsts = ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("doc_id"))
    one = Window.orderBy(F.desc("part"))
    before = firsts.select("doc_id", F.coalesce(F.lag("part").over(one), F.min("part").over(Window.partitionBy())).alias("part"))
    guests = docs.join(F.broadcast(before), "doc_id").select("doc_id", "text", "part", F.lit(1).alias("guest"))
    own = docs.select("doc_id", "text", part.alias("part"), F.lit(0).alias("guest"))
    dealt = own.union(guests).repartition("part").withColumn("fingerprint", fingerprint("text"))
    w = Window.partitionBy("part").orderBy("guest", F.desc("doc_id"), "text")
    nothing = F.lit("")
    known = F.col("doc_id").isNotNull()
    return dealt.select(
        "doc_id", "text", "fingerprint", "guest",
        F.when(known, F.lead("text").over(w)).otherwise(nothing).alias("next_text"),
        F.when(known, F.lead("fingerprint").over(w)).otherwise(nothing).alias("next_fingerprint"),
    ).filter("guest = 0")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document has its last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document, by descending doc_id, after the last the first. Null
    texts are empty. Rows that repeat a doc_id are documents of their own, in order of text; a null
    doc_id has no next document, so it meets an empty text, and is nobody's next. An empty table
    gives an empty result; columns but doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    half = "int(floor(length(text) / 2))"
    edited = with_next(rows).withColumn("edited", F.expr(f"concat(left(text, length(text) - {half}), left(next_text, {half}))"))
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint("edited").alias("edited_fingerprint"),
        "next_fingerprint",
    ).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return document_fingerprints(read_table(spark, sf_dir, "documents"))
