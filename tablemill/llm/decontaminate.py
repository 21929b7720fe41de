"""Benchmark decontamination by spaced-seed hashing.

Each mask looks at some of the words in a short span and ignores the rest, so a substituted word
spoils only the masks that look at it. Benchmark hashes and the hashes of each document are joined;
around every hit the two word sequences are laid side by side on that diagonal, and the overlap
counts if its best segment, or a stretch of which SHARE is equal, has enough equal words. Texts
shorter than a mask have masks of their own: the whole text, or all of it but one word.

The benchmark is read in blocks of at most BLOCK_SEEDS hashes. A block (a few MB, whatever the
benchmark's size) is broadcast, and the documents stream past it once; they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import Memo, Published, _coefficients, byte_texts, mixed, prepare, read_table, shared

#: Word positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 7, 9), (0, 1, 3, 6, 8, 9), (0, 2, 3, 5, 8, 9), (0, 1, 2, 3, 4, 5))
#: Benchmark texts of fewer words count only where a document holds them whole.
MIN_ITEM = 8
#: An overlap needs so many equal words, or this share of a shorter text; a mismatch costs PENALTY matches,
#: so that a stretch of total 0 is equal by this share.
MIN_EQUAL, SHARE, PENALTY = 13, 0.8, 4
#: Hashes of a block of the benchmark at most (one text is never split).
BLOCK_SEEDS = 200_000

#: Masks of texts shorter than the longest mask by their words: a substitution in the middle leaves no six words in a row.
_SHORT = {n: (tuple(range(n)),) for n in range(1, MIN_ITEM)} | {
    n: (MASKS[3], *(tuple(k for k in range(n) if k != gap) for gap in range(n - 6, 6))) for n in range(MIN_ITEM, 10)
}
ALL_MASKS = (*MASKS, *(m for n in sorted(_SHORT) for m in _SHORT[n] if m not in MASKS))

_BY = _coefficients(16, 23)


def masks_of(n: int) -> list[int]:
    """Indices of the masks for a text of n words."""
    return [ALL_MASKS.index(m) for m in _SHORT.get(n, MASKS)]


class NormalHashes(Memo):
    """Hash of a raw word's lower-case form without outer punctuation; 0 if nothing is left."""

    def make(self, word: bytes) -> int:
        text = word.decode(errors="replace").casefold()
        a, b = 0, len(text)
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        return xxhash.xxh3_64_intdigest(text[a:b].encode()) | 1 if a < b else 0


def normal_words(text: bytes, memo: NormalHashes) -> np.ndarray:
    words = text.split()
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    return h[h != 0]


def seed_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of mask k at each position where its span fits."""
    mask = ALL_MASKS[k]
    n = len(h) - mask[-1]
    if n <= 0:
        return h[:0]
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for at, by in zip(mask, _BY, strict=False):
        out += h[at : at + n] * by
    return mixed(out)


def needed(n: int) -> int:
    """Equal words that an overlap with a text of n words needs."""
    return n if n < MIN_ITEM else min(MIN_EQUAL, int(np.ceil(SHARE * n)))


def widest(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with most equal words of which SHARE or more are equal; ends are equal words."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    count = np.concatenate([[0], np.cumsum(equal)])
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -total, "left")
    last = int(np.argmax(count - count[first]))
    start = int(first[last])
    inside = np.flatnonzero(equal[start:last])
    return (start + int(inside[0]), start + int(inside[-1]) + 1) if len(inside) else (0, 0)


class Block:
    """Some benchmark texts: their words, and their sorted seed hashes with text and position."""

    def __init__(self, ids: list[int], texts: list[np.ndarray]):
        self.ids, self.texts = ids, texts
        self.masks = sorted({k for h in texts for k in masks_of(len(h))})
        hashes, owners, places = [], [], []
        for i, h in enumerate(texts):
            for k in masks_of(len(h)):
                s = seed_hashes(h, k)
                hashes.append(s)
                owners.append(np.full(len(s), i, dtype=np.int32))
                places.append(np.arange(len(s), dtype=np.int32))
        joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, np.int32)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int32)

    def sieve(self) -> tuple[np.ndarray, np.uint64]:
        """A table of 64 flags a hash or more, by a hash's high bits: most words miss it."""
        bits = min(26, max(16, int(np.ceil(np.log2(max(1, len(self.hashes)) * 64)))))
        shift = np.uint64(64 - bits)
        table = np.zeros(1 << bits, dtype=np.bool_)
        table[self.hashes >> shift] = True
        return table, shift

    def overlaps(self, h: np.ndarray, table: np.ndarray, shift: np.uint64) -> dict[int, tuple[int, int, int]]:
        """By text: (equal words, compared words, first word) of the best overlap that counts."""
        hits: list[np.ndarray] = []
        for k in self.masks:
            s = seed_hashes(h, k)
            at = np.flatnonzero(table[s >> shift]) if len(s) else s
            if not len(at):
                continue
            low, high = np.searchsorted(self.hashes, s[at], "left"), np.searchsorted(self.hashes, s[at], "right")
            n = high - low
            if not n.any():
                continue
            x = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            hits.append(np.stack([self.owners[x].astype(np.int64), np.repeat(at, n) - self.places[x]], axis=1))
        diagonals = np.unique(np.concatenate(hits), axis=0).tolist() if hits else []
        found: dict[int, tuple[int, int, int]] = {}
        for i, d in diagonals:
            text = self.texts[i]
            a, b = max(0, -d), min(len(text), len(h) - d)
            equal = text[a:b] == h[a + d : b + d]
            total, best, start, last, run = 0, 0, 0, 0, 0
            for k, same in enumerate(equal.tolist()):
                if total <= 0:
                    total, run = 0, k
                total += 1 if same else -PENALTY
                if total > best:
                    best, start, last = total, run, k + 1
            n, least = int(equal[start:last].sum()), needed(len(text))
            if n < least:
                start, last = widest(equal)
                n = int(equal[start:last].sum())
            if n >= least and n > found.get(i, (0,))[0]:
                found[i] = (n, last - start, a + d + start)
        return found


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) with the hashes of the text's words."""
    memo = shared("decontaminate", ("normal",), NormalHashes)
    for batch in batches:
        words = [normal_words(t or b"", memo).tobytes() for t in byte_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], ["item_id", "text", "words"])


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_SEEDS) -> Iterator[Block]:
    """Blocks of the benchmark's distinct texts, read in order of item_id; equal texts carry the least id."""
    memo, ids, texts, held = NormalHashes(), [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    first = rows.mapInArrow(_item_keys, "item_id long, text string, words binary").filter("words <> X''").groupBy(F.sha2("words", 256)).agg(F.min(F.struct("item_id", "text")).alias("x"))
    for row in first.select("x.*").orderBy("item_id", "text").toLocalIterator():
        h = normal_words(row.text.encode(), memo)
        if ids and held + len(h) * len(MASKS) > limit:
            yield Block(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(h)
        held += len(h) * len(MASKS)
    if ids:
        yield Block(ids, texts)


def _loaded(block: Block):
    return block, *block.sieve()


def _find(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, shift = block.made("decontaminate", _loaded)
        memo = shared("decontaminate", ("normal",), NormalHashes)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                found = own.overlaps(normal_words(text or b"", memo), table, shift)
                rows += [(doc_id, own.ids[i], *x) for i, x in sorted(found.items())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_equal", "n_compared", "first_word"])

    return run


def _filter(block, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, shift = block.made("decontaminate", _loaded)
        memo = shared("decontaminate", ("normal",), NormalHashes)
        for batch in batches:
            texts = byte_texts(batch.column(batch.schema.names.index(column)))
            yield batch.filter(pa.array([not own.overlaps(normal_words(t or b"", memo), table, shift) for t in texts], pa.bool_()))

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, n_compared, first_word): the best overlap of a document and a benchmark text.

    Words are compared in lower case without outer punctuation. Null texts are empty; equal
    benchmark texts count once, under the least item_id, whatever the blocks; repeated documents give
    repeated rows. Either table may be empty. Columns but these ids and texts are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "doc_id long, item_id long, n_equal long, n_compared long, first_word long")
    for block in benchmark_blocks(benchmark):
        out = out.union(docs.mapInArrow(_find(Published(spark, block)), out.schema))
    return out


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark passage stay as they are."""
    prepare(spark)
    for block in benchmark_blocks(read_table(spark, sf_dir, "benchmark")):
        docs = docs.mapInArrow(_filter(Published(spark, block), "text"), docs.schema)
    return docs


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
