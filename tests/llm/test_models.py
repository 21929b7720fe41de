import random
import zlib

import numpy as np
import pytest

from tablemill.llm import html_extract, licenses, token_counts, toxicity

SF = "/root/testdata/sf0.01"


# Toxicity


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network({"bad": 1, "word": 2}, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["words"][1:] = np.random.default_rng(2).normal(0, 0.3, net.p["words"][1:].shape)
    rng = np.random.default_rng(0)
    docs = [["bad", "word", "x1"] * 9, ["fine"], ["word", "zz"]]
    labels = np.array([1, 0, 0])

    class Keep:
        def random(self, n):
            return np.zeros(n)

    _, g = net.step(docs, labels, Keep())
    for name in ("char_uf", "char_wb", "char_a", "word_ub", "word_wf", "word_a", "out", "bias", "chars", "words"):
        flat = net.p[name].reshape(-1)
        for k in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old, eps = flat[k], 1e-4
            flat[k] = old + eps
            up = net.step(docs, labels, Keep())[0]
            flat[k] = old - eps
            down = net.step(docs, labels, Keep())[0]
            flat[k] = old
            if name == "words" and k < toxicity.WORD_DIM:
                continue
            assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[k]) < 1e-4, name


def test_windows_cover_everything():
    for n in (0, 1, 15, 16, 17, 24, 25, 100, 161):
        w = toxicity.windows_of(np.arange(n))
        assert set(w[w >= 0].tolist()) == set(range(n)) and w.shape[1] == toxicity.WINDOW


def test_long_texts_score_like_their_parts(monkeypatch):
    scorer = toxicity.Scorer(toxicity.Network({}, seed=3))
    words = [f"word{k % 97}" for k in range(4000)]
    text = " ".join(words).encode()
    whole = scorer.many([text])[0]
    monkeypatch.setattr(toxicity, "RUN_BYTES", 3000)
    assert scorer.many([text])[0] == pytest.approx(whole, abs=0.02)
    monkeypatch.setattr(toxicity, "TABLE_WORDS", 50)
    assert toxicity.Scorer(scorer.network).many([text, b"a b", b""])[0] == pytest.approx(whole, abs=0.02)


@pytest.fixture(scope="module")
def trained(spark):
    return toxicity.learned(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))


def test_held_out_accuracy_and_edges(spark, trained, monkeypatch):
    learned = toxicity.learned
    monkeypatch.setattr(toxicity, "learned", lambda docs, labels: trained)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "x y"), (10**6 + 1, "")], "doc_id long, text string")
    df = toxicity.toxicity(docs.select("doc_id", "text").union(extra), labels)
    rows = df.collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    monkeypatch.setattr(toxicity, "learned", learned)
    none = toxicity.toxicity(docs.limit(3), labels.limit(0))
    assert len({r.score for r in none.collect()}) == 1 and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_stage_keeps_clean_rows_whole(spark, trained, monkeypatch):
    monkeypatch.setattr(toxicity, "learned", lambda docs, labels: trained)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = toxicity.drop_toxic(spark, docs, SF)
    scored = {r.doc_id for r in toxicity.op2_toxicity(spark, SF).filter("predicted = 0").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == scored


# Token counts


def greedy(initial, inner, word):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        size = max((len(p) for p in pieces if p and word.startswith(p, at)), default=0)
        if not size:
            return 1
        n, at, pieces = n + 1, at + size, inner
    return n


def test_automaton_equals_greedy():
    rng = random.Random(8)
    for _ in range(200):
        make = lambda k: [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(k)]
        initial, inner = make(rng.randrange(1, 8)), make(rng.randrange(1, 8))
        m = token_counts.LongestMatch(initial, inner)
        for _ in range(40):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randrange(1, 12)))
            assert m.count(word) == greedy(initial, inner, word), (initial, inner, word)


def test_token_counts_on_documents(spark):
    from tablemill.llm.bpe import vocabulary_path

    with open(vocabulary_path(), "rb") as f:
        initial, inner = token_counts.vocabulary_pieces(f.read())
    heads, tails = set(initial), set(inner)

    def plain(word):
        n, at, pool = 0, 0, heads
        while at < len(word):
            size = next((k for k in range(min(40, len(word) - at), 0, -1) if word[at : at + k] in pool), 0)
            if not size:
                return 1
            n, at, pool = n + 1, at + size, tails
        return n

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.token_counts(docs).collect():
        words = texts[r.doc_id].encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(plain(b" " + w) for w in words))
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a  b"), (2, "é" * 50_000)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words) for r in token_counts.token_counts(odd).collect()}
    assert got == {(1, 0), (None, 2), (2, 1)} and token_counts.token_counts(odd.limit(0)).count() == 0


# Licences


def test_licences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    }
    planted = {(r.doc_id, k): want[line] for r in docs.collect() for k, line in enumerate(r.text.split("\n")) if line in want}
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.op4_license_scans(spark, SF).collect()}
    assert len(planted) > 20 and got == planted
    notice = "you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    rows = [(1, None), (2, ""), (3, "word " * 9000 + notice + " word" * 9000), (3, "licensed to drive a car"), (None, "Released under the BSD license.")]
    odd = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.family) for r in odd.collect()) == [("3", "LGPL"), ("None", "BSD")]
    assert licenses.licenses(docs.limit(0)).count() == 0


# HTML


def page(k, body, nav="<ul><li><a href='/a'>Start</a></li><li><a href='/b'>News</a></li></ul>"):
    return f"""<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a = "</p><p>no</p>";</script></head><body>
    <header><nav>{nav}</nav></header><div class="cookie-notice">We use cookies</div><div class="ad">Buy {k}</div>{body}
    <aside>Related {k}</aside><form><label>Mail</label><input></form><div id="comments"><p>reader {k}</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    body = "<article><h1>Head&nbsp;&amp; tail</h1><p>One <b>bold</b>\n  word.<p>Two<br>three<ul><li>a<li>b</ul><figure><figcaption>Cap</figcaption></figure></article>"
    assert html_extract.main_text(page(1, body), frozenset()) == "Head & tail\nOne bold word.\nTwo\nthree\na\nb\nCap"
    plain = "<div class='wrap'><div class='text'><p>" + "</p><p>".join(f"Sentence number {k} goes on and on until it is long enough to count." for k in range(4)) + "</p></div></div>"
    assert html_extract.main_text(page(1, plain), frozenset()).count("\n") == 3
    for odd in ("", "<", "<p", "</p></div>", "<!-- x", "<script>", "a < b & c", "<p>&#x41;&bogus;</p>"):
        assert isinstance(html_extract.main_text(odd, frozenset()), str)
    assert html_extract.main_text("<p>&#x41; b</p>", frozenset()) == "A b"


def test_templates_are_deduced_by_host(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(40):
        text = [" ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(10**6)) for _ in range(12)) + "." for _ in range(3)]
        lead = "Welcome to our house of news, where all the stories are fresh." if k < 30 else ""
        body = f"<div><p>{lead}</p></div><div>" + "".join(f"<p>{t}</p>" for t in text) + "</div>"
        rows.append((k, f"https://{'one' if k < 30 else 'two'}.example.com/{k}", f"<html><body><div>{body}</div><p>The end of all our pages on this fine host.</p></body></html>"))
        want[k] = "\n".join(text)
    rows += [(100, None, None), (101, "no url", ""), (102, "https://x.example.com/", "<p>" + "long text " * 60_000 + "</p>")]
    df = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in df.collect()}
    assert {k: got[k].text for k in want} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert got[100].text == "" and got[101].text == "" and got[102].n_chars == 60_000 * 10 - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
