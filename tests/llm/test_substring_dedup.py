import random
import sys
from itertools import combinations
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tablemill.llm import substring_dedup as sd


def plain(docs):
    para = {(i, k): line for i, t in docs.items() for k, line in enumerate((t or "").split("\n")) if len(brute.words(line)) >= sd.MIN_WORDS}
    sets = {p: brute.shingles(t) for p, t in para.items()}
    links = [(a, b) for a, b in combinations(sorted(para), 2) if 100 * len(sets[a] & sets[b]) >= sd.PERCENT * len(sets[a] | sets[b])]
    comp = brute.components(sorted(para), links)
    held = {}
    for p, c in comp.items():
        held.setdefault(c, set()).add(p[0])
    return {p: c for p, c in comp.items() if len(held[c]) > 1}


def result(df):
    return {(r.doc_id, r.paragraph): (r.cluster_doc_id, r.cluster_paragraph) for r in df.collect()}


def test_planted_passages(spark):
    rng = random.Random(7)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    passages = [line(rng.randrange(50, 90)).split() for _ in range(6)]
    docs = {}
    for i in range(60):
        parts = [line(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            p = list(passages[i % 6])
            for _ in range(rng.randrange(0, 2)):
                p[rng.randrange(len(p))] = "changed"
            parts.insert(rng.randrange(len(parts) + 1), " ".join(p))
        docs[i] = "\n".join(parts)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = result(sd.repeated_passages(df))
    assert got == plain(docs) and len(got) >= 20
    cut = {r.doc_id: r.text for r in sd.cut_stage(spark, df, "").collect()}
    for i, t in docs.items():
        gone = {k for (d, k), c in got.items() if d == i and c != (d, k)}
        assert cut[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)


def test_documents_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert result(sd.op9_substring_dedup(spark, "/root/testdata/sf0.001")) == plain({r.doc_id: r.text for r in rows})


def test_edge_cases(spark):
    long = " ".join(f"a{k}" for k in range(60))
    rows = [(1, None, 1), (2, "", 1), (3, long + "\n" + long, 60), (4, "x\n" + long.upper(), 7), (5, "only\n" + "b c d e f " * 9 + "\n" + "b c d e f " * 9, 3), (None, long, 2), (6, "word " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert result(sd.repeated_passages(docs)) == {(3, 0): (3, 0), (3, 1): (3, 0), (4, 1): (3, 0)}
    out = {r.doc_id: (r.text, r.n_chars) for r in sd.cut_stage(spark, docs, "").collect()}
    assert out[3] == (long, len(long)) and out[4] == ("x", 1) and out[1] == (None, 1) and out[None] == (long, 2) and len(out) == 7
    assert sd.repeated_passages(docs.limit(0)).count() == 0


def held_elsewhere(docs):
    """By document: the places of words in windows of 50 words that an earlier document holds, and that any other does."""
    held, w = {}, {i: brute.words(t) for i, t in docs.items()}
    for i, x in w.items():
        for p in range(len(x) - sd.WINDOW + 1):
            held.setdefault(tuple(x[p : p + sd.WINDOW]), set()).add(i)
    earlier, shared = {}, {}
    for i, x in w.items():
        for p in range(len(x) - sd.WINDOW + 1):
            own = held[tuple(x[p : p + sd.WINDOW])]
            for to, more in ((earlier, min(own) < i), (shared, len(own) > 1)):
                if more:
                    to.setdefault(i, set()).update(range(p, p + sd.WINDOW))
    return earlier, shared


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    return out


def test_passages_inside_lines_and_across_lines(spark):
    rng = random.Random(11)
    words = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    p, q, exact, short = words(60), words(75), words(50), words(49)
    wrapped = lambda x, n: "\n".join(" ".join(x[k : k + n]) for k in range(0, len(x), n))
    a, b = words(60), words(66)
    docs = {
        1: " ".join(a + p + b),
        2: " ".join(words(80) + [x.upper() for x in p] + words(46)),
        3: "head line\n" + wrapped(p, 9) + "\nlast line",
        4: "\n".join([" ".join(words(30) + q[:40]), " ".join(q[40:] + words(30))]),
        5: " ".join(words(100) + q + words(9)) + "\n",
        6: " ".join(words(70) + exact + words(70)), 7: " ".join(words(90) + exact + words(90)),
        8: " ".join(words(70) + short + words(70)), 9: " ".join(words(90) + short + words(90)),
        10: " ".join(words(40) + p + ["x"] + p + words(40)),
        11: None, 12: "word " * 300, 13: "word " * 300,
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    earlier, shared = held_elsewhere(docs)
    rows = sd.repeated_spans(df).collect()
    assert covered(r for r in rows if not r.kept) == earlier and covered(rows) == shared
    assert {(r.doc_id, r.first_word, r.n_words, r.source_doc_id) for r in rows if r.doc_id in (2, 5)} == {(2, 80, 60, 1), (5, 100, 75, 4)}
    cut = {r.doc_id: r.text for r in sd.cut_stage(spark, df, "").collect()}
    for i, t in docs.items():
        assert brute.words(cut[i]) == [w for k, w in enumerate(brute.words(t)) if k not in earlier.get(i, ())]
    assert cut[3] == "head line\nlast line" and all(cut[i] == docs[i] for i in (1, 4, 6, 8, 9, 11, 12))


def test_spans_of_documents_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    earlier, shared = held_elsewhere(docs)
    rows = sd.op9_repeated_spans(spark, "/root/testdata/sf0.001").collect()
    assert covered(r for r in rows if not r.kept) == earlier and covered(rows) == shared and len(shared) >= 30
