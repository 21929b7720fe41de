import random
import sys
from itertools import combinations
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tablemill.llm import neardup
from tablemill.llm import passages as ps
from tablemill.llm.common import WordHashes, shingle_hashes, word_hashes


def plain_cuts(words):
    """A cut before each word whose mark is the least of all marks within RADIUS of it, the first of equal ones."""
    h = word_hashes([w.encode() for w in words], WordHashes())
    if len(h) < ps.MARK:
        return [0] if len(h) else []
    m = shingle_hashes(h, ps.MARK).tolist()
    r = ps.RADIUS
    return [0] + [p for p in range(r, len(m) - r) if all(m[p] < x for x in m[p - r : p]) and all(m[p] <= x for x in m[p + 1 : p + r + 1])]


def plain(docs):
    """By document and kept: the sets of words of the repeated passages."""
    w = {i: brute.words(t) for i, t in docs.items()}
    para = {}
    for i, x in w.items():
        if len(x) >= ps.LEAST:
            c = plain_cuts(x)
            para |= {(i, a): (b - a, brute.shingles(" ".join(x[a:b]))) for a, b in zip(c, [*c[1:], len(x)])}
    links = []
    for a, b in combinations(sorted(para), 2):
        s, t = para[a][1], para[b][1]
        if 100 * len(s & t) >= ps.PERCENT * len(s | t):
            links.append((a, b))
    comp, held = brute.components(sorted(para), links), {}
    for p, c in comp.items():
        held.setdefault(c, set()).add(p[0])
    parts = [(i, a, para[i, a][0], min(held[c])) for (i, a), c in comp.items() if len(held[c]) > 1]
    windows = {}
    for i, x in w.items():
        for p in range(len(x) - ps.WINDOW + 1):
            windows.setdefault(tuple(x[p : p + ps.WINDOW]), []).append((i, p))
    for where in windows.values():
        first = min(i for i, _ in where)
        if any(i != first for i, _ in where):
            parts += [(i, p, ps.WINDOW, first) for i, p in where]
    covered = {}
    for i, at, n, first in parts:
        covered.setdefault((i, i == first), set()).update(range(at, at + n))
    out = {}
    for key, some in covered.items():
        start = [p for p in some if p - 1 not in some]
        for a in start:
            b = a
            while b in some:
                b += 1
            if b - a >= ps.LEAST:
                out.setdefault(key, set()).add((a, b - a))
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.kept), set()).add((r.first_word, r.n_words))
    return out


def fixture(seed):
    rng = random.Random(seed)
    words = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    lines = lambda x: "".join(w + rng.choice([" ", " ", " ", " ", "\n"]) for w in x)
    pool = [words(rng.randrange(50, 160)) for _ in range(6)]
    docs = {}
    for i in range(60):
        x = words(rng.randrange(0, 150))
        for _ in range(rng.randrange(0, 3)):
            p = list(pool[rng.randrange(6)])
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed%d" % i
            at = rng.randrange(len(x) + 1)
            x[at:at] = [w.upper() for w in p] if rng.random() < 0.3 else p
        docs[i] = lines(x)
    return docs


def test_passages_against_brute_force(spark):
    for seed in (3, 4):
        docs = fixture(seed)
        got = result(ps.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))
        assert got == plain(docs) and sum(map(len, got.values())) > 40


def test_documents_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = result(ps.op9_substring_dedup(spark, "/root/testdata/sf0.001"))
    assert got == plain(docs) and len(got) >= 30


def test_cut_takes_all_but_the_first(spark):
    docs = fixture(5)
    df = spark.createDataFrame([(i, t, len(t), f"s{i}") for i, t in docs.items()], "doc_id long, text string, n_chars long, source string")
    out = {r.doc_id: r for r in ps.cut_stage(spark, df, "").collect()}
    gone = {i: {k for a, n in found for k in range(a, a + n)} for (i, kept), found in plain(docs).items() if not kept}
    assert set(out) == set(docs) and len(gone) > 20
    for i, t in docs.items():
        assert brute.words(out[i].text) == [w for k, w in enumerate(brute.words(t)) if k not in gone.get(i, ())]
        assert out[i].n_chars == len(out[i].text) and out[i].source == f"s{i}" and (i in gone or out[i].text == t)


def test_sets_that_lie_behind_each_other(monkeypatch):
    rng = np.random.default_rng(1)
    hasher = ps.MinHasher(ps.BANDS, ps.ROWS)
    parts = [rng.integers(0, m, n, dtype=np.uint64) for n, m in ((1, 9), (5, 9), (0, 9), (40, 3), (3, 9), (200, 2**63), (4, 9), (90, 2), (0, 9))]
    sets = [np.unique(shingle_hashes(p)) for p in parts]
    elements, counts = neardup.sets_of(parts)
    assert [x.tolist() for x in np.split(elements, np.cumsum(counts)[:-1])] == [x.tolist() for x in sets]
    one, two = neardup.set_keys(elements, counts)
    assert list(zip(one.tolist(), two.tolist())) == [neardup.set_key(x) if len(x) else (0, 0) for x in sets]
    want = np.array([hasher.signature(x) for x in sets])
    for size in (1, 3, 7, 64, 10**6):
        monkeypatch.setattr(neardup, "AT_ONCE", size)
        assert (neardup.minima(elements, counts, hasher) == want).all()
    assert (neardup.band_keys(want, hasher) == np.array([hasher.band_keys(x) for x in want])).all()


def test_texts_sketched_together_are_as_alone():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, m, n, dtype=np.uint64) for n, m in ((50, 2**63), (51, 2), (700, 2**63), (99, 3), (100, 2**63), (1500, 40), (50, 1))]
    hasher = ps.MinHasher(ps.BANDS, ps.ROWS)
    rows = ps._group(list(range(7)), texts, hasher).to_pylist()
    for k, h in enumerate(texts):
        (alone,) = ps._group([k], [h], hasher).to_pylist()
        assert rows[k] == alone
        least = [min(shingle_hashes(h[p : p + ps.WINDOW], ps.MARK_WORDS).tolist()) for p in range(len(h) - ps.WINDOW + 1)]
        assert {x % 2**64 for x in alone["marks"]} == set(least)
        assert alone["at"] == ps.cuts(h).tolist() and sum(alone["n_words"]) == len(h)


def test_window_hashes_depend_on_the_window_only():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**64, 400, dtype=np.uint64)
    long = np.concatenate([rng.integers(0, 2**64, 90_000, dtype=np.uint64), h])
    assert (ps.window_hashes(h) == ps.window_hashes(long)[90_000:]).all() and len(set(ps.window_hashes(h).tolist())) == 351
    swapped = h.copy()
    swapped[[0, 49]] = h[[49, 0]]
    assert ps.window_hashes(swapped)[0] != ps.window_hashes(h)[0]


def test_edge_cases(spark):
    rng = random.Random(1)
    p = " ".join("p%d" % rng.randrange(10**6) for _ in range(60))
    x, y = "".join(f"x{k} xx{k} xxx{k}\n" for k in range(30)), "".join(f"\ny{k} yy{k}" for k in range(30))
    rows = [
        (1, None, 1, "a"), (2, "", 1, "a"), (3, p, 1, "a"), (3, p, 1, "b"), (3, "other words here", 1, "c"), (None, p, 2, "a"), (4, x + p.upper() + y, 7, "a"),
        (5, "only one of it " + "junk " * 100_000, 3, "a"), (6, "in itself " + " ".join(["q%d" % k for k in range(70)] * 2), 4, "a"), (7, " ".join(p.split()[:49]), 5, "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string").withColumnsRenamed({"key": "first_word"})
    found = plain({r[0]: r[1] for r in rows if r[0] is not None and not str(r[1]).startswith("other")})
    ((at, n),) = found[4, False]
    assert result(ps.repeated_passages(docs)) == found == {(3, True): {(0, 60)}, (4, False): {(at, n)}} and at <= 90 and at + n >= 150 and n <= 75
    cut = ps.cut_stage(spark, docs.withColumnRenamed("first_word", "kept"), "")
    out = sorted(map(tuple, cut.collect()), key=str)
    assert cut.columns == ["doc_id", "text", "n_chars", "kept"]
    (left,) = [r[1] for r in out if r[0] == 4]
    w = (x + p + y).split()
    assert left.split() == w[:at] + w[at + n :]
    assert out == sorted([r for r in rows if r[0] != 4] + [next(r for r in out if r[0] == 4)], key=str)
    assert ps.repeated_passages(docs.limit(0)).count() == 0 and ps.cut_stage(spark, docs.limit(0), "").count() == 0


def test_large_group_of_copies(spark):
    rng = random.Random(2)
    p = ["p%d" % rng.randrange(10**6) for _ in range(80)]
    rows = [(k, " ".join([f"a{k}.{j}" for j in range(50 + k % 5)] + p + [f"b{k}.{j}" for j in range(40)])) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r.doc_id: r for r in ps.repeated_passages(docs).collect()}
    assert set(got) == set(range(3000)) and all(r.kept == (k == 0) and r.source_doc_id == 0 for k, r in got.items())
    # A paragraph at an end may bring words around the passage along, a fifth of its own at most.
    assert all(r.first_word <= 50 + k % 5 and r.first_word + r.n_words >= 130 + k % 5 and r.n_words <= 100 for k, r in got.items())
