import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablemill.llm import bpe

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def codec():
    with open(bpe.vocabulary_path(), "rb") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def ids(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), dtype="<u4").tolist()


def plain_merge(merges, data):
    """The least rank first, leftmost first, one merge at a time."""
    rank = {}
    for k, (a, b, c) in enumerate(merges.merges):
        rank.setdefault((a, b), (k, c))
    out = [merges.byte_ids[b] for b in data]
    while True:
        found = min(((rank[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in rank), default=None)
        if found is None:
            return out
        i = found[1]
        out[i : i + 2] = [rank[(out[i], out[i + 1])][1]]


def test_equals_the_library(codec, library):
    rng = random.Random(1)
    texts = ["", SPECIAL, f"a{SPECIAL}b {SPECIAL} <|endof", "don't it'll 've  x\n\n  y\t z ", " ", "  ", "\x1c \x85 \xa0a", "é é 日本語 🙂🙂"]
    for alphabet in ("ab", "etaoin shr", "é🙂 \n", "  \n", " a", "1a!'s "):
        texts += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (3, 90, 70_000)]
    for t in texts:
        assert ids(codec, t) == library.encode(t, add_special_tokens=False).ids
        assert "".join(codec.decode(codec.encode(t))) == t


def test_bulk_equals_one_by_one(codec):
    rng = random.Random(2)
    data = [bytes(rng.choice(b"etaoinshr .,x\xc3\xa9") for _ in range(rng.randrange(1, 49))) for _ in range(3000)]
    assert codec.merges.bulk(data) == [codec.merges.short(d) for d in data]
    for d in data[:300]:
        assert codec.merges.merge(d) == plain_merge(codec.merges, d) == codec.merges._long([codec.merges.byte_ids[b] for b in d])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_lookahead_is_sufficient(seed):
    rng = random.Random(seed)
    table, merges = [bytes([b]) for b in b"abc"], []
    for _ in range(12):
        a, b = rng.randrange(len(table)), rng.randrange(len(table))
        if table[a] + table[b] not in table:
            merges.append((a, b, len(table)))
            table.append(table[a] + table[b])
    byte_ids = [0] * 256
    for k, b in enumerate(b"abc"):
        byte_ids[b] = k
    m = bpe.MergeList(merges, table, byte_ids)
    text = bytes(rng.choice(b"abc") for _ in range(60))
    whole = plain_merge(m, text)
    ends = np.cumsum([len(table[t]) for t in whole]).tolist()
    for stop in range(1, len(text)):
        end = 0
        for k, t in enumerate(plain_merge(m, text[:stop])):
            end += len(table[t])
            if end + m.lookahead[t] > stop:
                break
            assert whole[k] == t and ends[k] == end

    class Small(bpe.MergeList):
        window = property(lambda self: self.sufficient + 1)

    machine, at, out = bpe.Transducer(Small(merges, table, byte_ids)), 0, []
    while at < len(text):
        n = rng.randrange(1, 9)
        out += machine.feed(text[at : at + n])
        assert len(machine.held) <= machine.merges.window
        at += n
    assert out + list(machine.feed(b"", last=True)) == whole


def test_decoder_replaces_what_is_not_utf8(codec, library):
    rng = random.Random(4)
    for _ in range(50):
        some = [rng.randrange(50257) for _ in range(40)]
        runs = [np.array(some[:17], "<u4").tobytes(), np.array(some[17:], "<u4").tobytes()]
        assert "".join(codec.decode(runs)) == library.decode(some, skip_special_tokens=False)


def test_frames(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "Hello hello", 5), (3, "Hello hello", 5), (None, "x", None), (4, "word " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = bpe.encode_decode(docs).collect()
    assert len(got) == 6


    by = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}
    for i, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (i, len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in by
    staged = bpe.encode_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, ids long"), "")
    assert staged.columns[:2] == ["doc_id", "text"] and staged.filter("doc_id = 3").first().ids == library.encode("Hello hello").ids
    assert bpe.encode_decode(docs.limit(0)).count() == 0
