"""Passages that repeat across documents, wherever they start and end, by MinHash banding of paragraphs.

A paragraph here doesn't depend on line ends. A text's words are cut where the hash of the next MARK
words is the least within RADIUS words to either side, so a passage is cut alike in every document
that holds it. The paragraphs (LEAST words or more, about twice that on average) go through
bands that are tuned for high recall at the threshold; colliding ones are verified on their exact
5-word shingle sets (see neardup), and components of the links, with equal sets as one, are clusters.

The ends of a passage lie inside the paragraphs at its ends. They are found on overlapping
paragraphs of WINDOW words, one at each word: both documents of a shared one have the same least
shingle in it, so only those whose least shingle two documents hold are compared, by a hash of all
their words. Paragraphs that repeat and such windows are joined where they touch, and make a
repeated passage if they reach LEAST words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import MinHasher, WordHashes, byte_texts, columns_of, fresh, mixed, prepare, read_table, shared, shingle_hashes, sifted, tidied, word_hashes, words_of, written
from tablemill.llm.neardup import band_keys, linked_components, minima, set_keys, sets_of
from tablemill.llm.substring_dedup import WINDOW, _held_twice, tuned_bands

#: Words of a repeated passage.
LEAST = 50
#: Words that a cut looks at, and to either side of it.
MARK, RADIUS = 3, LEAST - 1
PERCENT = 80
#: Words of the shingles of which a window's least one stands for it, and words of texts that are sketched together.
MARK_WORDS, GROUP_WORDS = 10, 40_000
#: A pair of paragraphs at the threshold shares no band with a probability below MISS.
ROWS, MISS = 2, 2.5e-3
BANDS = tuned_bands(PERCENT / 100, ROWS, MISS)
#: Paragraphs of a chunk of a coarse group.
CHUNK = 1000

SKETCH = "doc_id long, marks array<bigint>, at array<int>, n_words array<int>, n array<int>, s1 array<bigint>, s2 array<bigint>, bands array<bigint>, doubles array<bigint>"


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return x


def cut_places(h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Starts of the paragraphs of several texts of hashed words that lie behind each other, in order; a text's first is its own."""
    m = shingle_hashes(h, MARK)
    n = len(m) - 2 * RADIUS
    if len(h) < MARK or n <= 0:
        return first
    side, centre = sliding_least(m, RADIUS), m[RADIUS : RADIUS + n]
    at = np.flatnonzero((centre < side[:n]) & (centre <= side[RADIUS + 1 : RADIUS + 1 + n])) + RADIUS
    text = np.searchsorted(first, at, "right") - 1
    whole = (at - RADIUS >= first[text]) & (at + RADIUS + MARK <= stop[text])
    return np.sort(np.concatenate([first, at[whole]]))


def cuts(h: np.ndarray) -> np.ndarray:
    """Starts of the paragraphs of one text."""
    return cut_places(h, np.zeros(min(1, len(h)), np.int64), np.array([len(h)][: min(1, len(h))], np.int64))


def nested(values: np.ndarray, ends: np.ndarray, kind=None) -> pa.Array:
    """A list array: the values up to each end."""
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def _group(ids: list, texts: list[np.ndarray], hasher: MinHasher) -> pa.RecordBatch:
    """The sketch of some texts of LEAST words or more, run together."""
    h, size = np.concatenate(texts), np.array([len(x) for x in texts])
    stop = np.cumsum(size)
    first = stop - size
    # The least shingle of a window, once for each stretch of windows that share it.
    least = sliding_least(shingle_hashes(h, MARK_WORDS), WINDOW - MARK_WORDS + 1)
    at = np.arange(int((size - WINDOW + 1).sum())) + np.repeat(first - (np.cumsum(size - WINDOW + 1) - (size - WINDOW + 1)), size - WINDOW + 1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    at = at[new]
    starts = cut_places(h, first, stop)
    words = np.diff(starts, append=len(h))
    elements, counts = sets_of(np.split(h, starts[1:]))
    one, two = set_keys(elements, counts)
    bands = band_keys(minima(elements, counts, hasher), hasher)
    ends = np.searchsorted(starts, stop)
    # A paragraph with the next one of its text, or alone if there is but one: a hash of their words.
    behind = np.minimum(np.arange(len(starts)) + 1, np.repeat(ends, np.diff(ends, prepend=0)) - 1)
    doubles = stretch_hashes(h, starts, (starts + words)[behind])
    own = starts - np.repeat(first, np.diff(ends, prepend=0))
    ints = pa.int32()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), nested(least[at], np.searchsorted(at, stop)), nested(own, ends, ints), nested(words, ends, ints), nested(counts, ends, ints),
            nested(one, ends), nested(two, ends), nested(bands.reshape(-1), ends * BANDS), nested(doubles, ends),
        ],
        ["doc_id", "marks", "at", "n_words", "n", "s1", "s2", "bands", "doubles"],
    )


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the least shingles of a text's windows and its paragraphs; texts under LEAST words give no row."""
    hasher, memo = shared("near", ("minhash", BANDS, ROWS), lambda: MinHasher(BANDS, ROWS)), shared("near", ("words",), WordHashes)
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            h = word_hashes(words_of(text or b""), memo)
            if len(h) >= LEAST:
                ids.append(doc_id)
                texts.append(h)
                held += len(h)
            if held >= GROUP_WORDS:
                yield _group(ids, texts, hasher)
                ids, texts, held = [], [], 0
        if ids:
            yield _group(ids, texts, hasher)


#: Odd factor of the window hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def stretch_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words of each stretch: a polynomial in BASE, from sums over the beginnings of the text."""
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    return mixed((total[stop] - total[start]) * powers(BACK, len(h) + 1)[start] + (stop - start).astype(np.uint64))


def window_hashes(h: np.ndarray) -> np.ndarray:
    """stretch_hashes() of each window."""
    start = np.arange(len(h) - WINDOW + 1)
    return stretch_hashes(h, start, start + WINDOW)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, marks, later) to the windows whose least shingle is one of marks and that lie in none of the stretches later."""
    memo = shared("near", ("words",), WordHashes)
    for batch in batches:
        marks, later = batch.column(2), batch.column(3)
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True)):
            h = word_hashes(words_of(text or b""), memo)
            if len(h) < WINDOW:
                continue
            least = sliding_least(shingle_hashes(h, MARK_WORDS), WINDOW - MARK_WORDS + 1)
            known = np.sort(marks[k].values.to_numpy().view(np.uint64))
            spot = np.searchsorted(known, least)
            wanted = known[np.minimum(spot, len(known) - 1)] == least
            for x in later[k].as_py() or ():
                wanted[x["at"] : x["at"] + x["n_words"] - WINDOW + 1] = False
            at = np.flatnonzero(wanted)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), doc_id, np.int64)), pa.array(at.astype(np.int32)), pa.array(window_hashes(h)[at].view(np.int64))], ["doc_id", "at", "key"]
                )


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: list of (at, n_words, id)) to (id, text of the paragraph), where the text holds it."""
    memo = shared("near", ("words",), WordHashes)
    for batch in batches:
        ids, texts = [], []
        for text, wanted in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = words_of(text or b"")
            for x in wanted:
                own = words[x["at"] : x["at"] + x["n_words"]]
                if own and int(set_keys(*sets_of([word_hashes(own, memo)]))[0][0]) == x["id"]:
                    ids.append(x["id"])
                    texts.append(b" ".join(own))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "text"])


def _near_paragraphs(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc_id, at, n_words, key, first_doc) of the paragraphs whose cluster at least two documents hold."""
    fields = "posexplode(arrays_zip(at, n_words, n, s1, s2)) as (k, x)"
    units = sketch.selectExpr("doc_id", fields).select("doc_id", "x.at", "x.n_words", "x.n", F.col("x.s1").alias("id"), "x.s2")
    banded = sketch.selectExpr("bands", fields).selectExpr("x.s1 as id", "x.n as n", f"slice(bands, k * {BANDS} + 1, {BANDS}) as bands")

    def texts_of(first: DataFrame) -> DataFrame:
        lists = written(first.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n_words", "id")).alias("wanted")))
        held = sifted(docs, "doc_id", lists.select("doc_id"))[0]
        return held.join(lists, "doc_id").select("text", "wanted").mapInArrow(_pick, "id long, text string")

    found = linked_components(banded, texts_of, BANDS, ROWS, PERCENT, units.select("id", "doc_id", "at", "n_words"), CHUNK)
    least = F.min("doc_id").alias("least"), F.max("doc_id").alias("last")
    classes = written(units.groupBy("id", "n", "s2").agg(*least))
    joined = classes.join(found, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    # Without a link a class is a cluster of its own, also where two sets have the same id.
    alone = joined.filter("component is null and least < last").select("id", "n", "s2", F.col("least").alias("first_doc"))
    linked = written(joined.filter("component is not null"))
    clusters = written(linked.groupBy("cluster").agg(F.min("least").alias("first_doc"), F.max("last").alias("last_doc")).filter("first_doc < last_doc"))
    several = linked.join(clusters, "cluster").select("id", "n", "s2", "first_doc")
    named = written(alone.union(several))
    may = sifted(units, "id", named.select("id"))[0]
    return may.join(named, ["id", "n", "s2"]).select("doc_id", "at", "n_words", F.col("id").alias("key"), "first_doc")


def _exact_runs(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc_id, at, n_words, key, first_doc): runs of windows that at least two documents hold.

    A stretch of two paragraphs that an earlier document holds word by word gives no windows here:
    the paragraphs are repeated ones already, and whatever else holds such a window meets it in that earlier document.
    """
    stretch = "posexplode(doubles) as (k, key)"
    size = "n_words[k] + if(k + 1 < size(n_words), n_words[k + 1], 0)"
    doubles = sketch.selectExpr("doc_id", "at", "n_words", stretch).selectExpr("doc_id", "key", "at[k] as at", f"{size} as n_words")
    later = _held_twice(doubles).filter("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set(F.struct("at", "n_words")).alias("later"))
    wanted = written(_held_twice(sketch.select("doc_id", F.explode("marks").alias("key"))).groupBy("doc_id").agg(F.collect_set("key").alias("marks")).join(later, "doc_id", "left"))
    held = sifted(docs, "doc_id", wanted.select("doc_id"))[0]
    windows = written(held.join(wanted, "doc_id").select("doc_id", "text", "marks", "later").mapInArrow(_windows, "doc_id long, at int, key long"))
    rows = _held_twice(windows).withColumn("kept", F.col("doc_id") == F.col("first_doc"))
    run = F.col("at") - F.dense_rank().over(Window.partitionBy("doc_id", "kept").orderBy("at"))
    return (
        rows.withColumn("run", run)
        .groupBy("doc_id", "kept", "run")
        .agg(F.min("at").alias("at"), (F.max("at") - F.min("at") + WINDOW).alias("n_words"), F.min_by("key", "at").alias("key"), F.min("first_doc").alias("first_doc"))
        .select("doc_id", "at", "n_words", "key", "first_doc")
    )


@tidied
def parts_of_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the paragraphs and runs of windows that make up the repeated passages.

    Columns: doc_id, at, n_words, key, exact (a run of windows), first_doc, kept, and first_word and
    passage_words of the passage. A written table.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sketch = written(docs.mapInArrow(_sketch, SKETCH))
    near = _near_paragraphs(docs, sketch).withColumn("exact", F.lit(False))
    runs = _exact_runs(docs, sketch).withColumn("exact", F.lit(True))
    parts = near.unionByName(runs).withColumn("kept", F.col("doc_id") == F.col("first_doc")).withColumn("stop", F.col("at") + F.col("n_words"))
    own = Window.partitionBy("doc_id", "kept").orderBy("at", "stop", "key")
    reached = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("at") > F.coalesce(reached, F.lit(-1)), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("doc_id", "kept", "island")
    out = (
        parts.withColumn("island", island)
        .withColumn("first_word", F.min("at").over(whole))
        .withColumn("passage_words", F.max("stop").over(whole) - F.min("at").over(whole))
        .filter(F.col("passage_words") >= LEAST)
        .select("doc_id", "at", "n_words", "key", "exact", "first_doc", "kept", "first_word", "passage_words")
    )
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to the passages of LEAST words or more that at least two documents hold.

    Columns: doc_id, first_word (0-based, in the whole text), n_words, source_doc_id (the least
    document that holds a part of it), n_parts (paragraphs and runs of WINDOW equal words or more)
    and kept. Part by part, the document of least doc_id keeps a passage. Words are
    compared as in shingles; line ends count as any other space. A passage that repeats inside one document only is no such passage.
    Null texts are empty, rows with a null doc_id take no part, rows that repeat a doc_id are one
    document. An empty table gives an empty result; columns but doc_id and text are not read.
    """
    return (
        parts_of_passages(docs).dropDuplicates(["doc_id", "kept", "at", "n_words", "exact"])
        .groupBy("doc_id", "kept", "first_word", F.col("passage_words").alias("n_words"))
        .agg(F.min("first_doc").alias("source_doc_id"), F.count("*").alias("n_parts"))
        .select("doc_id", "first_word", "n_words", "source_doc_id", "n_parts", "kept")
    )


def without_words(text: bytes, cut: np.ndarray, places: list) -> bytes:
    """text without the words that cut marks; a line of which no word is left goes too."""
    out, at = [], 0
    for row, words in zip(text.split(b"\n"), places, strict=True):
        own = cut[at : at + len(words)]
        at += len(words)
        if len(own) and own.all():
            continue
        if own.any():
            ends = [m.start() for m in words[1:]] + [len(row)]
            row = row[: words[0].start()] + b"".join(row[m.start() : e] for m, e, c in zip(words, ends, own.tolist(), strict=True) if not c)
        out.append(row)
    return b"\n".join(out)


def without(text: bytes, parts: list[dict], memo: WordHashes) -> bytes:
    """text without these parts; one whose key isn't that of the text's words there is passed over."""
    places = [list(re.finditer(rb"[^\x20\x09-\x0D]+", x)) for x in text.split(b"\n")]
    h = word_hashes([m.group().lower() for x in places for m in x], memo)
    cut = np.zeros(len(h), dtype=bool)
    for x in parts:
        at, n = x["at"], x["n_words"]
        if at + n > len(h):
            continue
        if x["exact"]:
            key = int(window_hashes(h[at : at + WINDOW]).view(np.int64)[0])
        else:
            key = int(set_keys(*sets_of([h[at : at + n]]))[0][0])
        if key == x["key"]:
            cut[at : at + n] = True
    return without_words(text, cut, places)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column has parts of the text, or null: text without them."""
    memo = shared("near", ("words",), WordHashes)
    for batch in batches:
        at = batch.schema.names.index("text")
        out = []
        for text, parts in zip(byte_texts(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            out.append(text if text is None or not parts else without(text, parts, memo))
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.binary()).cast(batch.schema.field(at).type))


def cut_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut out of all documents but the first that holds them.

    Every row stays; text and n_chars follow the cut, line ends stay where words are left. Rows that
    lose nothing are passed on as they are, unshuffled, as are nulls. Rows that repeat a doc_id lose the same parts, as far
    as their texts hold them. An empty table stays empty; other columns are carried, whatever their names.
    """
    own, lost = fresh(docs, "gone_id"), fresh(docs, "gone_parts")
    gone = parts_of_passages(docs).filter("not kept").dropDuplicates(["doc_id", "at", "n_words", "exact"]).groupBy(F.col("doc_id").alias(own)).agg(
        F.collect_list(F.struct("at", "n_words", "key", "exact")).alias(lost)
    )
    gone = written(gone)
    may, stay = sifted(docs, "doc_id", gone.select(own))
    out = may.join(gone, may["doc_id"] == gone[own], "left")
    out = out.mapInArrow(_cut, out.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return stay.union(out.select(*columns_of(out, docs.columns)))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
