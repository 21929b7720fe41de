import random

from tablemill.llm import decontaminate as dc


def brute(doc, item):
    """Best overlap on any diagonal by trying all segments."""
    memo = dc.NormalHashes()
    h, t = (dc.normal_words(x.encode(), memo).tolist() for x in (doc, item))
    best = 0
    for d in range(-len(t) + 1, len(h)):
        total = run = 0
        score = 0
        for i in range(len(t)):
            if 0 <= i + d < len(h):
                if total <= 0:
                    total = run = 0
                same = h[i + d] == t[i]
                total, run = total + (1 if same else -dc.PENALTY), run + same
                if total > score:
                    score, best_run = total, run
        best = max(best, best_run if score else 0)
    return best


def test_passages_are_caught_and_others_left(spark):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(3000)
    items = {i: [word() for _ in range(rng.randrange(8, 60))] for i in range(30)}
    docs, leaked = {}, {}
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 300))]
        if i % 2:
            item = items[i % 30]
            passage = [word() if k % 12 == 7 and len(item) > 20 else w.upper() + "," * (k % 3 == 0) for k, w in enumerate(item)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
            leaked[i] = i % 30
        docs[i] = " ".join(text)
    a = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in dc.contaminated(a, b).collect()}
    assert {d for d, _ in got} == set(leaked) and all((d, i) in got for d, i in leaked.items())
    for (d, i), n in got.items():
        assert n == brute(docs[d], " ".join(items[i]))


def test_blocks_give_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    assert len(list(dc.benchmark_blocks(bench, 500))) > 3
    monkeypatch.setattr(dc, "benchmark_blocks", lambda b, f=dc.benchmark_blocks: f(b, 500))
    assert sorted(map(tuple, dc.contaminated(docs, bench).collect())) == whole
    left = {r.doc_id for r in dc.drop_contaminated(spark, docs, "/root/testdata/sf0.001").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {x[0] for x in whole}


def test_edge_cases(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, passage, 1), (3, passage, 1), (None, passage, 1), (4, "x " * 50_000 + passage, 1)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(5, passage, 0), (4, passage.upper(), 0), (None, passage, 0), (6, None, 0), (7, "too few words", 0)], "item_id long, text string, doc_id long")
    got = sorted(map(tuple, dc.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([(3, 4, 20, 20, 0), (3, 4, 20, 20, 0), (None, 4, 20, 20, 0), (4, 4, 20, 20, 50_000)], key=str)
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), bench).count() == 0


def test_substitutions_and_short_items(spark):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(10**6)
    items = {n: [word() for _ in range(n)] for n in (*range(1, 16), 20, 40, 60)}
    docs, want, n_equal = {}, set(), {}

    def add(n, gone):
        text = [word() for _ in range(30)]
        text[17:17] = [word() if k in gone else w for k, w in enumerate(items[n])]
        docs[len(docs)] = " ".join(text)
        return len(docs) - 1

    for n in range(1, 16):
        want.add((add(n, ()), n))
        for k in range(n):
            i = add(n, (k,))
            if n >= 8:
                want.add((i, n))
                n_equal[i] = n - 1
    for n in (20, 40, 60):
        for off in range(1, 4):
            i = add(n, range(off, n, 5))
            want.add((i, n))
    add(15, (1, 4, 7, 10)), add(20, range(0, 20, 3))
    a = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(a, b).collect()}
    assert set(got) == want
    assert all(r.n_equal <= n_equal.get(d, 60) and 5 * r.n_equal >= 4 * min(13, r.n_compared) for (d, _), r in got.items())
