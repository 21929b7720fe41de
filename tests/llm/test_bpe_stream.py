import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tablemill.llm import bpe


@pytest.fixture(scope="module")
def codec():
    with open(bpe.vocabulary_path(), "rb") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def ids(runs):
    return np.frombuffer(b"".join(runs), dtype="<u4").tolist()


def test_slices_of_any_size_give_the_same(codec, library):
    rng = random.Random(11)
    texts = ["a" * 90, " " * 40 + "x", "x" + " " * 40, "\n \n" * 30 + "y", "''''''''''ll've" * 5, "1234567890" * 9, "!?" * 50 + "'s it's", "é" * 60, "don't 'tis  'S 12ab  x\x85\x1c z", "日本語" * 40]
    for alphabet in ("ab", "etaoin shr", "é🙂 \n", "  \n", " a", "1a!'s ", "'restvmld ", " \t\r\n　x"):
        texts += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (30, 150, 400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        for _ in range(6):
            stream, out, at = bpe.Stream(codec), [], 0
            while at < len(t):
                n = rng.choice((1, 2, 3, 5, 9, 17, 60))
                out += stream.feed(t[at : at + n], last=at + n >= len(t))
                at += n
            assert ids(out) == want, t


def test_stable_tokens_stand_whatever_follows(codec, library):
    rng = random.Random(12)
    for _ in range(400):
        word = "".join(rng.choice(("in", "ter", "nation", "al", "iz", "th", "e", "s", "an", "é", "ou")) for _ in range(rng.randrange(1, 7)))
        stable = codec.merges.stable(word.encode())
        for _ in range(12):
            more = "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(0, 12)))
            assert library.encode(word + more, add_special_tokens=False).ids[: len(stable)] == stable


def test_lookahead_decides_on_documents(spark, library, monkeypatch):
    """The whole table, equal to the library; tokens leave a piece before its end is known."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    with open(bpe.vocabulary_path(), "rb") as f:
        own = bpe.Codec(f.read())
    monkeypatch.setattr(bpe, "SLICE", 1000)
    want = {}
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        packed = np.array(e.ids, "<u4").tobytes()
        want[r.doc_id] = (len(e.ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
        assert own.round_trip(r.text or "") == want[r.doc_id]
    assert own.early > 50
    monkeypatch.undo()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_memory_of_long_pieces_is_constant(codec):
    def peak(n, char):
        stream, most = bpe.Stream(codec), 0
        tracemalloc.start()
        for _ in range(n):
            for _ in stream.feed(char * 4000):
                most = max(most, len(stream.machine.held), len(stream.tail))
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most <= codec.merges.window
        return used

    for char in ("ab", " ", "-é", "12"):
        codec.merges.stable(b"warm up")
        peak(2, char)
        assert peak(40, char) < 1.5 * peak(8, char) + 100_000


def test_stage_with_clashing_columns(spark, tmp_path):
    rows = [(1, "Hello", 9, "a", "b", 7, 1), (1, "Hello", 9, "a", "b", 7, 1), (2, None, None, None, None, None, None), (None, "", 1, "", "", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, ids_sha256 string, DECODED_sha256 string, ids int, n_chars int")
    bpe.encode_stage(spark, docs, "").write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [0, 0, 1, 1] and {r.n_chars for r in got} == {1, None, 0}
