"""Passages that repeat across documents, by MinHash banding of paragraphs.

A paragraph is a line of at least MIN_WORDS words. The bands are tuned for high recall at the
threshold; colliding paragraphs are verified on their exact 5-word shingle sets, and the removals
are clustered by connected components. One occurrence of each cluster stays: the first by
(doc_id, paragraph).

Passages that sit inside a line or run over several lines are found on the whole word stream: all
windows of WINDOW words that two documents hold, joined to maximal runs. Both documents of such a
window have the same least shingle in it, so only windows whose least shingle is shared are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import MinHasher, WordHashes, byte_texts, drop, prepare, read_table, shared, shingle_hashes, sifted, word_hashes, words_of, written
from tablemill.llm.neardup import linked_components, longs_list, set_key

#: Shorter lines are not passages.
MIN_WORDS = 25
PERCENT = 80


def tuned_bands(similarity: float, rows: int, miss: float) -> int:
    """Fewest bands of `rows` minima that miss a pair at `similarity` with probability <= miss."""
    return int(np.ceil(np.log(miss) / np.log1p(-(similarity**rows))))


ROWS = 4
BANDS = tuned_bands(PERCENT / 100, ROWS, 1e-3)

#: Words of a window of the word stream, and of the shingles that stand for it.
WINDOW, MARK = 50, 10

PARAGRAPHS = "doc_id long, idx int, n_words int, n long, s1 long, s2 long, bands array<bigint>"


def _paragraphs(min_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, memo = shared("near", ("minhash", bands, rows), lambda: MinHasher(bands, rows)), shared("near", ("words",), WordHashes)
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                for idx, line in enumerate((text or b"").split(b"\n")):
                    if len(line) < 2 * min_words - 1 or len(words := words_of(line)) < min_words:
                        continue
                    elements = np.unique(shingle_hashes(word_hashes(words, memo)))
                    s1, s2 = set_key(elements)
                    row = (doc_id, idx, len(words), len(elements), s1, s2, hasher.band_keys(hasher.signature(elements)))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(out, kinds, strict=False)), longs_list(out[6])],
                ["doc_id", "idx", "n_words", "n", "s1", "s2", "bands"],
            )

    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: list of (idx, id)) to (id, text of the paragraph)."""
    for batch in batches:
        ids, texts = [], []
        for text, wanted in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            for x in wanted:
                if x["idx"] < len(lines):
                    ids.append(x["id"])
                    texts.append(lines[x["idx"]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "text"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) to the occurrences of passages that at least two documents hold.

    Columns: doc_id, paragraph (0-based line), n_words, cluster_doc_id and cluster_paragraph (the
    occurrence that stays), n_occurrences, kept. Two paragraphs are linked if their
    5-word shingle sets have a Jaccard similarity of percent / 100 or more; clusters are components.
    A paragraph repeated inside one document only is no such passage. Null texts are empty, rows
    with a null doc_id take no part, and rows that repeat a doc_id are one document. An empty
    table gives an empty result; columns but doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    bands = tuned_bands(percent / 100, ROWS, 1e-3)
    para = written(docs.mapInArrow(_paragraphs(min_words, bands, ROWS), PARAGRAPHS))
    classes = written(
        para.groupBy("s1", "s2", "n").agg(
            F.min(F.struct("doc_id", "idx", "bands")).alias("first"),
            F.max("doc_id").alias("last"),
            F.count("*").alias("count"),
        ).select(F.col("s1").alias("id"), "s2", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.idx").alias("idx"), F.col("first.bands").alias("bands"), "last", "count")
    )
    texts_of = lambda wanted: (
        docs.join(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("idx", "id")).alias("wanted")), "doc_id")
        .select("text", "wanted").mapInArrow(_pick, "id long, text string")
    )
    found = linked_components(classes.select("id", "n", "bands"), texts_of, bands, ROWS, percent, classes.select("id", "doc_id", "idx"))
    of_class = classes.select("id", "s2", "n", "doc_id", "idx", "last", "count").join(found, "id", "left").withColumn(
        "cluster", F.coalesce("component", "id")
    )
    clusters = (
        of_class.groupBy("cluster")
        .agg(F.min(F.struct("doc_id", "idx")).alias("first"), F.max("last").alias("last"), F.sum("count").alias("n_occurrences"))
        .filter("first.doc_id < last")
    )
    named = of_class.select(F.col("id").alias("s1"), "s2", "n", "cluster").join(clusters, "cluster")
    return para.select("doc_id", "idx", "n_words", "n", "s1", "s2").join(named, ["n", "s1", "s2"]).select(
        "doc_id",
        F.col("idx").alias("paragraph"),
        "n_words",
        F.col("first.doc_id").alias("cluster_doc_id"),
        F.col("first.idx").alias("cluster_paragraph"),
        "n_occurrences",
        ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("idx") == F.col("first.idx"))).alias("kept"),
    )


def least_marks(h: np.ndarray) -> np.ndarray:
    """The least shingle hash of each window of WINDOW words; h holds as many words at least."""
    m, have, want = shingle_hashes(h, MARK), 1, WINDOW - MARK + 1
    while have < want:
        step = min(have, want - have)
        m, have = np.minimum(m[:-step], m[step:]), have + step
    return m


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = shared("near", ("words",), WordHashes)
    for batch in batches:
        ids, out = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            h = word_hashes(words_of(text or b""), memo)
            if len(h) >= WINDOW:
                ids.append(doc_id)
                out.append(np.unique(least_marks(h)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), longs_list(out)], ["doc_id", "marks"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, marks) to the windows whose least shingle is one of marks."""
    memo = shared("near", ("words",), WordHashes)
    for batch in batches:
        marks = batch.column(2)
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True)):
            h = word_hashes(words_of(text or b""), memo)
            if len(h) < WINDOW:
                continue
            at = np.flatnonzero(np.isin(least_marks(h), marks[k].values.to_numpy().view(np.uint64)))
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), doc_id, np.int64)), pa.array(at.astype(np.int32)), pa.array(shingle_hashes(h, WINDOW)[at].view(np.int64))],
                    ["doc_id", "at", "key"],
                )


def _held_twice(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, key, ...) whose key at least two documents hold, with the least of them in first_doc.

    Keys are counted with partial sums first, so a key in a third of all rows is one row a task;
    then only rows whose key may be held twice are shuffled, and a skewed key can be dealt anew.
    """
    held = written(rows.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc").select("key", "first_doc"))
    return sifted(rows, "key", held.select("key"))[0].join(held, "key")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the runs of WINDOW words or more that at least two documents hold.

    Columns: doc_id, first_word (0-based, in the whole text), n_words, source_doc_id (the least
    document that holds a window of the run), key (hash of the first window) and kept. A run is a
    maximal row of windows that other documents hold too; it is kept in the first document that holds its windows.
    Words are compared as in shingles; line ends count as any other space. Nulls and repeated ids as in repeated_passages.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    marks = written(docs.mapInArrow(_marks, "doc_id long, marks array<bigint>"))
    wanted = _held_twice(marks.select("doc_id", F.explode("marks").alias("key"))).groupBy("doc_id").agg(F.collect_set("key").alias("marks"))
    windows = written(docs.join(wanted, "doc_id").select("doc_id", "text", "marks").mapInArrow(_windows, "doc_id long, at int, key long"))
    drop(marks)
    held = _held_twice(windows.distinct()).withColumn("kept", F.col("doc_id") == F.col("first_doc"))
    run = F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "kept").orderBy("at"))
    return (
        held.withColumn("run", run)
        .groupBy("doc_id", "kept", "run")
        .agg(F.min("at").alias("first_word"), (F.max("at") - F.min("at") + WINDOW).alias("n_words"), F.min("first_doc").alias("source_doc_id"), F.min_by("key", "at").alias("key"))
        .select("doc_id", "first_word", "n_words", "source_doc_id", "key", "kept")
    )


def without(text: bytes, lines: list[int], spans: list[tuple[int, int, int]], memo: WordHashes) -> bytes:
    """text without these lines and word spans (first word, words, hash of the first window).

    A line of which spans leave no word goes too; a span that the text doesn't hold is passed over.
    """
    rows, gone = text.split(b"\n"), set(lines)
    if not spans:
        return b"\n".join(x for k, x in enumerate(rows) if k not in gone)
    places = [list(re.finditer(rb"[^\x20\x09-\x0D]+", x)) for x in rows]
    h = word_hashes([m.group().lower() for x in places for m in x], memo)
    cut = np.zeros(len(h), dtype=bool)
    for at, n, key in spans:
        if at + n <= len(h) and int(shingle_hashes(h[at : at + WINDOW], WINDOW).view(np.int64)[0]) == key:
            cut[at : at + n] = True
    out, at = [], 0
    for k, (row, words) in enumerate(zip(rows, places, strict=True)):
        own = cut[at : at + len(words)]
        at += len(words)
        if k in gone or (len(own) and own.all()):
            continue
        if own.any():
            ends = [m.start() for m in words[1:]] + [len(row)]
            row = row[: words[0].start()] + b"".join(row[m.start() : e] for m, e, c in zip(words, ends, own.tolist(), strict=True) if not c)
        out.append(row)
    return b"\n".join(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with _lines and _spans (null if a document loses none): text without them."""
    memo = shared("near", ("words",), WordHashes)
    for batch in batches:
        at = batch.schema.names.index("text")
        out = []
        for text, lines, spans in zip(byte_texts(batch.column(at)), batch.column("_lines").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            if text is not None and (lines or spans):
                text = without(text, lines or [], [(x["first_word"], x["n_words"], x["key"]) for x in spans or []], memo)
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()).cast(batch.schema.field(at).type))


def cut_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut out of all documents but the first that holds them.

    Passages are whole lines (repeated_passages) and runs of words (repeated_spans). Every document
    stays; text and n_chars follow the cut.
    """
    lines = repeated_passages(docs).filter("not kept").select(
        "doc_id", F.col("paragraph").alias("line"), F.lit(None).cast("struct<first_word int, n_words int, key bigint>").alias("span")
    )
    spans = repeated_spans(docs).filter("not kept").select("doc_id", F.lit(None).cast("int").alias("line"), F.struct("first_word", "n_words", "key").alias("span"))
    gone = lines.union(spans).groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set("line").alias("_lines"), F.collect_list("span").alias("_spans"))
    out = docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left")
    out = out.mapInArrow(_cut, out.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone_id").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def op9_repeated_spans(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
