import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from tablemill.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def test_runs_score_exactly_like_the_whole(monkeypatch):
    rng = random.Random(1)
    network = tx.Network({"bad": 1}, seed=3)
    for n in (0, 1, 15, 16, 17, 40, 333, 2000):
        words = [rng.choice(["bad", "fine", "...", "x" * 40, "été", f"w{rng.randrange(300)}"]) for _ in range(n)]
        text = rng.choice([" ", "\n"]).join(words).encode()
        whole = tx.Scorer(network).many([text])[0]
        for size in (1, 7, 100, 1000):
            monkeypatch.setattr(tx, "RUN_BYTES", size)
            assert tx.Scorer(network).many([b"before", text, b"behind"])[1] == pytest.approx(whole, abs=1e-6), (n, size)
            monkeypatch.undo()


def test_scoring_runs_without_a_tape_and_like_the_taped_pass(monkeypatch):
    rng = np.random.default_rng(4)
    network = tx.Network({"bad": 1, "other": 2}, seed=3)
    network.p["words"] = rng.normal(0, 1, network.p["words"].shape).astype(np.float32)
    for k in [x for x in network.p if x.split("_")[-1] in ("bf", "bb", "a")]:
        network.p[k] = rng.normal(0, 1, network.p[k].shape).astype(np.float32)
    words = ["bad", "other", "a", "\u00e9t\u00e9", "x" * 16, "word", "longer"]
    v = network.word_vectors(words)[0]
    p = network.p
    table = np.concatenate([v @ p["word_wf"] + p["word_bf"], v @ p["word_wb"] + p["word_bb"]], axis=1)
    windows = rng.integers(0, 7, (9, tx.WINDOW))
    padded = windows.copy()
    for k in range(8):
        padded[k, k:] = -1
    want = []
    for w in (windows, padded):
        g, mask = table[w.T], (w.T >= 0).astype(np.float32)
        want.append(tx.WORD.forward(p, g[:, :, : 3 * tx.WORD_H], g[:, :, 3 * tx.WORD_H :], mask)[0] @ p["out"] + p["bias"][0])
    monkeypatch.setattr(tx, "gru", None)
    for k, w in enumerate(words):
        assert np.allclose(network.gates([w, w]), table[[k, k]], atol=1e-5)
    for w, logits in zip((windows, padded), want, strict=True):
        assert np.allclose(network.logits(table, w), logits, atol=1e-5)


MEMORY = """
import re, sys
sys.path.insert(0, sys.argv[1])
from tablemill.llm import common, toxicity as tx
peak = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
network, before, own = tx.Network({}, seed=1), peak(), held()
for k in range(2):
    texts = [" ".join("%x" % (hash((k, i, j)) % 16**12) for j in range(1000)).encode() for i in range(70)]
    common.shared("toxicity", "scorer", lambda: tx.Scorer(network)).many(texts)
    del texts
print(peak() - before)
common.shared("near", "nothing", lambda: 0)
print(held() - own)
"""


def test_memory_of_a_worker():
    """140,000 different words take less than 120 MB, and the next stage finds that free."""
    out = subprocess.run([sys.executable, "-c", MEMORY, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))], capture_output=True, text=True, check=True, env=os.environ | {"OMP_NUM_THREADS": "1", "PYTHONHASHSEED": "1"})
    most, left = map(float, out.stdout.split())
    assert most < 120 and left < 12, (most, left)


def auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_held_out_quality(spark):
    """On labels that were never learned; the table's labels hold some noise of their own."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.learned(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    y = np.array([r.toxic for r in rows])
    score = tx.Scorer(model).many([r.text.encode() for r in rows])
    said = score >= tx.THRESHOLD
    assert y.sum() > 100 and auc(score, y) > 0.94 and said[y == 1].mean() > 0.85 and y[said].mean() > 0.85


def test_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(tx, "learned", lambda docs, labels: tx.Network({}, seed=1))
    docs = spark.createDataFrame([(1, "a b", 5.0, 1, True), (1, "a b", None, 0, None)], "doc_id long, text string, score double, predicted int, held_out boolean")
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, toxic int, text string")
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == 2 and len({r.score for r in got}) == 1 and got[0].held_out == (zlib.crc32(b"1") % 4 == 2)
