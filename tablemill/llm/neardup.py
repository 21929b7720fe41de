"""Near-duplicate links by banded MinHash, sequential Bayesian pruning and exact verification.

The plan, for documents as for paragraphs:

1. Equal sets meet first: from here on a class of equal sets is one item, so thousands of copies
   cost one row each and no pair.
2. Items that share a band key are candidates. Only stars (item, least item of the bucket) are
   kept, and their components are the coarse groups: each link lies inside one of them.
3. A coarse group is split into chunks of bounded size by a hash, and each pair of chunks is a
   block. One task holds one block at a time. A large group may hang together by chance alone, and
   one such group grows with the corpus: where its stars have fewer pairs than the whole, it falls
   apart into them. A star has all items of the buckets of one least item, so each pair that shares a
   band meets in a star; small stars are packed into blocks, large ones are split into chunks.
4. In a block, pairs that share a band are compared by batches of their signatures. A pair is
   pruned as soon as the posterior probability that its similarity reaches the threshold falls
   below MISS; survivors are verified on their whole sets, most similar first, and pairs that are
   already connected inside the block are skipped, so a block returns a forest, not its pairs.
5. The components of the verified links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import (
    SHINGLE,
    MinHasher,
    WordHashes,
    byte_texts,
    mixed,
    shared,
    shingle_hashes,
    sifted,
    tidied,
    word_hashes,
    words_of,
    written,
)
from tablemill.llm.components import connected_components

#: Chosen probability to prune a pair whose similarity reaches the threshold, per batch.
MISS = 1e-6
#: Hashes of a batch in the sequential comparison.
BATCH = 20
#: Items and shingles that a chunk holds on average at most.
CHUNK_ITEMS, CHUNK_SHINGLES = 400, 1_500_000
#: Shingles whose minima are taken at once.
AT_ONCE = 1 << 15


def least_matches(compared: int, threshold: float, miss: float = MISS) -> int:
    """Fewest matches among `compared` hashes that keep P(similarity >= threshold) >= miss.

    With a uniform prior, the posterior after m matches is Beta(m + 1, compared - m + 1), whose
    upper tail at t is P(Binomial(compared + 1, t) <= m).
    """
    n, tail = compared + 1, 0.0
    for m in range(compared + 1):
        tail += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if tail >= miss:
            return m
    return compared


def distinct_shingles(text: bytes, memo: WordHashes) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words_of(text), memo)))


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that stand for a set."""
    one = int(elements.sum(dtype=np.uint64)) if len(elements) else 0
    two = int(mixed(elements ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)) if len(elements) else 0
    return (one ^ (1 << 63)) - (1 << 63), (two ^ (1 << 63)) - (1 << 63)


def sets_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of several sequences of word hashes, sorted and behind each other, and their counts."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    own = np.maximum(size - SHINGLE + 1, 0)
    place = np.repeat(np.arange(len(parts)), own)
    at = np.arange(len(place)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(np.cumsum(size) - size, own)
    values = shingle_hashes(np.concatenate(parts))[at] if len(at) else np.zeros(0, np.uint64)
    if (short := np.flatnonzero((size > 0) & (own == 0))).size:
        values = np.concatenate([values, *(shingle_hashes(parts[k]) for k in short)])
        place = np.concatenate([place, short])
    if len(parts) <= 1 << 16:
        # One fast sort by place and the first 48 bits; should two values share those, a full sort decides.
        short_key = place.astype(np.uint64) << np.uint64(48) | values >> np.uint64(16)
        order = np.argsort(short_key)
        short_key = short_key[order]
        if ((short_key[1:] == short_key[:-1]) & (values[order][1:] != values[order][:-1])).any():
            order = np.lexsort((values, place))
    else:
        order = np.lexsort((values, place))
    values, place = values[order], place[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (place[1:] != place[:-1])
    return values[first], np.bincount(place[first], minlength=len(parts))


def set_keys(elements: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """set_key() of several sets that lie behind each other."""
    ends = np.cumsum(counts)

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return (total[ends] - total[ends - counts]).view(np.int64)

    return sums(elements), sums(mixed(elements ^ np.uint64(0x5DEECE66D)))


def minima(elements: np.ndarray, counts: np.ndarray, hasher: MinHasher) -> np.ndarray:
    """Signatures of several sets that lie behind each other."""
    out = np.full((len(counts), len(hasher.times)), 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[filled]
    low = (elements >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(low), AT_ONCE):
        b = min(len(low), a + AT_ONCE)
        first = int(np.searchsorted(starts, a, "right")) - 1
        own = np.maximum(starts[first : int(np.searchsorted(starts, b, "left"))] - a, 0)
        rows = filled[first : first + len(own)]
        out[rows] = np.minimum(out[rows], np.minimum.reduceat((low[a:b, None] ^ hasher.plus) * hasher.times, own, axis=0))
    return out


def band_keys(signatures: np.ndarray, hasher: MinHasher) -> np.ndarray:
    """MinHasher.band_keys() of several signatures, a row for each."""
    parts = signatures.reshape(len(signatures), hasher.bands, hasher.rows).astype(np.uint64)
    return mixed((parts * hasher.band_by).sum(axis=2, dtype=np.uint64) + np.arange(hasher.bands, dtype=np.uint64))


def longs_list(rows: list[np.ndarray]) -> pa.Array:
    """A list<int64> array from arrays of 64-bit integers."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows).view(np.int64) if len(rows) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def stars_of(items: DataFrame) -> DataFrame:
    """(id, bands) to (a, b), written: an item and the least item of a bucket that it shares.

    A bucket is first met as the least and the greatest item of each task, so one that holds a third
    of all items is one row a task; only items of buckets with several are shuffled after that.
    """
    keys = items.select("id", F.explode("bands").alias("key"))
    buckets = written(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key", "low"))
    edges = sifted(keys, "key", buckets.select("key"))[0].join(buckets, "key").filter("id > low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    return written(edges.distinct())


def _chunks(chunk: int):
    return F.ceil(F.greatest(F.col("m") / chunk, F.col("total") / CHUNK_SHINGLES)).cast("int").alias("chunks")


def grouped(stars: DataFrame, members: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, component, kind, part) and (component, kind, part, chunks): what is compared with each other, and its size.

    stars as of stars_of(), members (id, n, component), both written. kind 0: a whole coarse group; 1: a star that is
    larger than a chunk, by its least item; 2: a pack of small stars. An item can be in several of the last two.
    """
    sums = F.count("*").alias("m"), F.sum("n").alias("total")
    sizes = written(members.groupBy("component").agg(*sums).select("component", "m", _chunks(chunk)))
    whole = F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part")
    rows, sized = members.select("id", "component", *whole), sizes.select("component", *whole, "chunks")
    wide = sizes.filter("chunks > 1")
    if wide.isEmpty():
        return rows, sized
    both = stars.select(F.col("a").alias("id"), F.col("b").alias("least")).union(stars.selectExpr("b", "b").distinct())
    held = written(both.join(members.join(wide.select("component"), "component", "left_semi"), "id"))
    of_star = written(held.groupBy("component", "least").agg(*sums).select("component", "least", "m", "total", _chunks(chunk)))
    small = lambda c: F.sum(F.when(F.col("chunks") == 1, F.col(c)).otherwise(0))
    parts = F.greatest(F.lit(1), F.ceil(2 * F.greatest(small("m") / chunk, small("total") / CHUNK_SHINGLES))).cast("int").alias("parts")
    apart = written(
        of_star.groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"), parts)
        .join(wide.select("component", F.col("m").alias("all")), "component").filter("2 * pairs < all * all").select("component", "parts")
    )
    large = F.col("chunks") > 1
    kind, part = F.when(large, 1).otherwise(2).alias("kind"), F.when(large, F.col("least")).otherwise(F.expr("pmod(xxhash64(least), parts)")).alias("part")
    placed = written(of_star.join(apart, "component").select("component", "least", kind, part, "chunks"))
    stars_rows = held.join(placed, ["component", "least"]).select("id", "component", "kind", "part").distinct()
    rest = lambda df: df.join(apart, "component", "left_anti")
    return written(rest(rows).unionByName(stars_rows)), written(rest(sized).unionByName(placed.select("component", "kind", "part", "chunks").distinct()))


#: What tells blocks apart.
BLOCK = ["component", "kind", "part", "low", "high"]


def blocks_of(members: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of each block: (component, kind, part, low, high, chunk, id, text), sorted by block in a task.

    members (id, component, kind, part) and sizes (component, kind, part, chunks) come from written tables, so a skewed join can be dealt anew.
    """
    chunked = members.join(sizes, BLOCK[:3]).withColumn("chunk", F.expr("int(pmod(xxhash64(id), chunks))"))
    return (
        chunked.join(texts, "id")
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select(
            *BLOCK[:3],
            F.least("chunk", "other").alias("low"),
            F.greatest("chunk", "other").alias("high"),
            "chunk",
            "id",
            "text",
        )
        .repartition(*BLOCK)
        .sortWithinPartitions(*BLOCK)
    )


def links_in_block(ids, texts, chunks, hasher: MinHasher, percent: int, memo: WordHashes) -> list[tuple[int, int]]:
    """Verified links that connect the block's items, most similar first.

    chunks: the chunk of each item; in a block of two chunks only pairs across them count, since
    each chunk has a block of its own for the pairs inside it.
    """
    elements, n = sets_of([word_hashes(words_of(t), memo) for t in texts])
    sets = np.split(elements, np.cumsum(n)[:-1])
    sigs = minima(elements, n, hasher)
    bands = band_keys(sigs, hasher)
    chunks = np.array(chunks)
    across = chunks.min() != chunks.max()
    width, threshold = sigs.shape[1], percent / 100
    stops = [*range(BATCH, width, BATCH), width]
    needed = [least_matches(k, threshold) for k in stops]
    found = []
    for i in range(len(ids) - 1):
        j = np.flatnonzero((bands[i + 1 :] == bands[i]).any(axis=1)) + i + 1
        j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
        if across:
            j = j[chunks[j] != chunks[i]]
        matches, at = np.zeros(len(j), dtype=np.int64), 0
        for stop, least in zip(stops, needed, strict=True):
            if not len(j):
                break
            matches = matches + (sigs[j, at:stop] == sigs[i, at:stop]).sum(axis=1)
            keep = matches >= least
            j, matches, at = j[keep], matches[keep], stop
        if len(j):
            found.append(np.stack([matches, np.full(len(j), i), j]))
    if not found:
        return []
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.argsort(-pairs[0], kind="stable")]
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(pairs[1].tolist(), pairs[2].tolist(), strict=True):
        a, b = root(i), root(j)
        if a == b:
            continue
        x, y = (sets[i], sets[j]) if n[i] <= n[j] else (sets[j], sets[i])
        spot = np.searchsorted(y, x)
        spot[spot == len(y)] = 0
        shared_n = int((y[spot] == x).sum())
        if 100 * shared_n >= percent * (len(x) + len(y) - shared_n):
            parent[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def _verify(bands: int, rows: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, memo = shared("near", ("minhash", bands, rows), lambda: MinHasher(bands, rows)), shared("near", ("words",), WordHashes)
        key, held = None, ([], [], [])

        def flush():
            found = links_in_block(*held, hasher, percent, memo) if len(held[0]) > 1 else []
            if found:
                return pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"]
                )
            return None

        for batch in batches:
            names = batch.schema.names
            get = lambda c: batch.column(names.index(c))
            rows_ = zip(zip(*(get(c).to_pylist() for c in BLOCK), strict=True), get("chunk").to_pylist(), get("id").to_pylist(), byte_texts(get("text")), strict=True)
            for block, chunk, item, text in rows_:
                if block != key:
                    if (out := flush()) is not None:
                        yield out
                    key, held = block, ([], [], [])
                held[0].append(item)
                held[1].append(text or b"")
                held[2].append(chunk)
        if (out := flush()) is not None:
            yield out

    return run


@tidied
def linked_components(items: DataFrame, texts, bands: int, rows: int, percent: int, places: DataFrame | None = None, chunk: int = CHUNK_ITEMS) -> DataFrame:
    """Items (id, n, bands), which may repeat, and their texts to (id, component) of the verified links.

    texts: (id, text), or a function that gets the least row of `places` of each candidate and
    returns (id, text) for them. chunk: items of a chunk, more if they are small.
    """
    stars = stars_of(items)
    groups = connected_components(stars)
    once = sifted(items.select("id", "n"), "id", groups.select("id"))[0].groupBy("id").agg(F.max("n").alias("n"))
    members = written(once.join(groups, "id"))
    compared, sizes = grouped(stars, members, chunk)
    if places is not None:
        # The least place of each item, by partial aggregates first: an item may have a third of all places.
        least = F.min(F.struct(*[c for c in places.columns if c != "id"])).alias("x")
        first = sifted(places, "id", members.select("id"))[0].groupBy("id").agg(least).select("id", "x.*")
        texts = texts(first.join(members.select("id"), "id", "left_semi"))
    else:
        texts = sifted(texts, "id", members.select("id"))[0]
    links = written(blocks_of(compared, sizes, texts).mapInArrow(_verify(bands, rows, percent), "a long, b long"))
    return connected_components(links)
