import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tablemill.llm import minhash_dedup, neardup
from tablemill.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def noisy(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.near({r.doc_id: r.text for r in docs.collect()})
    got = minhash_dedup.op8_minhash_near_dedup(spark, SF)
    assert result(got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_group_of_noisy_copies_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_ITEMS", 7)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    docs = {i: " ".join(noisy(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))) for i in range(60)}
    docs |= {100 + i: " ".join(f"v{rng.randrange(10**6)}" for _ in range(40)) for i in range(20)}
    got = result(minhash_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))
    assert got == brute.near(docs)


def test_group_that_hangs_together_by_chance(spark, monkeypatch):
    """A chain of texts that share bands with their neighbours only, a few of them links: work grows with its length, not the square."""
    rng, n = random.Random(5), 600
    stretch = [[f"s{k}.{j}" for j in range(8)] for k in range(n + 7)]
    texts = {k: " ".join(sum(stretch[k : k + 8], [])) for k in range(n)}
    texts |= {1000 + k: texts[k] + " end" for k in rng.sample(range(n), 20)}
    texts |= {2000 + k: " ".join([f"h{j}" for j in range(90)] + [f"t{k}"]) for k in range(30)} | {3000: " ".join(sum(stretch[7:11], []) + [f"h{j}" for j in range(30)])}
    hasher, memo = neardup.MinHasher(6, 2), neardup.WordHashes()
    sets = {i: neardup.distinct_shingles(t.encode(), memo) for i, t in texts.items()}
    items = [(i, len(x), hasher.band_keys(hasher.signature(x)).view(np.int64).tolist()) for i, x in sets.items()]
    made, blocks_of = [], neardup.blocks_of
    monkeypatch.setattr(neardup, "blocks_of", lambda *a: made.append(blocks_of(*a)) or made[-1])
    counts = []
    written = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df: (counts.append(made[-1].count()) if made and df.columns == ["a", "b"] and not counts else None) or written(df))
    got = neardup.linked_components(
        spark.createDataFrame(items, "id long, n long, bands array<bigint>"), spark.createDataFrame(list(texts.items()), "id long, text string"), 6, 2, 80, chunk=10
    )
    links = [(i, j) for i in texts for j in texts if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    want = {i: c for i, c in brute.components(sorted(texts), links).items() if any(i in x for x in links)}
    assert {r.id: r.component for r in got.collect()} == want and len(want) > 60
    assert counts[0] < 6 * len(texts)


def test_edge_cases(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "one two", "x"), (5, "ONE  two", "x"), (6, "one", "x"),
        (7, "a b c d e f g " * 9000, "x"), (7, "a b c d e f g " * 9000, "x"), (None, "one two", "x"), (8, "É b", "x"), (9, "é b", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
         (7, 7, 7, True), (7, 7, 7, True), (None, 1, None, True), (8, 1, 8, True), (9, 1, 9, True)], key=str,
    )
    kept = minhash_dedup.keep_one(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id > 3").collect()) == [4, 6, 7, 7, 8, 9]
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (99, 100), (7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {99: 99, 100: 99}


def test_posterior_bound():
    rng = np.random.default_rng(0)
    least = neardup.least_matches(20, 0.85)
    assert 0 < least < 14
    drawn = rng.binomial(20, rng.uniform(0, 1, 400_000) * 0 + 0.85)
    assert (drawn < least).mean() < 1e-3
