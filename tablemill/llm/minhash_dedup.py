"""MinHash near-duplicate documents with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import MinHasher, WordHashes, byte_texts, columns_of, prepare, read_table, shared, sifted, tidied, written
from tablemill.llm.neardup import distinct_shingles, linked_components, longs_list, set_key

#: A pair at the threshold of 0.85 shares no band with probability (1 - 0.85**6)**20 < 1e-4.
BANDS, ROWS = 20, 6
PERCENT = 85

SKETCH = "doc_id long, n long, s1 long, s2 long, bands array<bigint>"


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, memo = shared("near", ("minhash", bands, rows), lambda: MinHasher(bands, rows)), shared("near", ("words",), WordHashes)
        for batch in batches:
            n, keys, out = [], [], []
            for text in byte_texts(batch.column(1)):
                elements = distinct_shingles(text or b"", memo)
                n.append(len(elements))
                keys.append(set_key(elements))
                out.append(hasher.band_keys(hasher.signature(elements)) if len(elements) else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), longs_list(out)],
                ["doc_id", "n", "s1", "s2", "bands"],
            )

    return run


@tidied
def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, kept).

    Documents are linked if the Jaccard similarity of their sets of 5-word shingles reaches
    percent / 100; component_id is the least doc_id reachable over links. A text without words
    (null or empty too) is linked with nothing. A null doc_id gives a null component and is kept;
    rows that repeat a doc_id count as one document. Columns but doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(docs.mapInArrow(_sketch(bands, rows), SKETCH))
    filled = sketch.filter("n > 0 and doc_id is not null")
    classes = written(
        filled.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"))
    )
    items = filled.select(F.col("doc_id").alias("id"), "n", "bands").join(classes.select("id"), "id", "left_semi")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    found = linked_components(items, texts, bands, rows, percent)
    member = (
        sketch.select("doc_id", "n", "s1", "s2")
        .join(classes.join(found, "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("least")), ["n", "s1", "s2"], "left")
    )
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return member.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies stays, the one of least doc_id.

    Rows with a null doc_id stay, and rows that repeat a doc_id stay or go together. Only rows that
    may go are shuffled.
    """
    dropped = written(near_duplicates(docs).filter("not kept").select("doc_id").distinct())
    may, stay = sifted(docs, "doc_id", dropped)
    gone = dropped.toDF("gone_id")
    return stay.union(may.join(gone, may["doc_id"] == gone["gone_id"], "left_anti").select(*columns_of(may)))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
