"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's vector joins a learned embedding of the word with the attention-pooled states of a
bidirectional GRU over its characters. A second bidirectional GRU with attention pooling runs over
each window of words and gives the window's logit. A text's score comes from its largest window
logit over the overlapping windows of the whole text: each starts STRIDE words, half a window, behind the
one before it, and the last one ends with the text.

The network learns from a bounded sample of labelled documents (SAMPLE by label, each of at most
SAMPLE_CHARS characters); a document's label is held against the soft maximum of its windows.
Only the texts are inputs.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import Published, byte_texts, prepare, read_table

WINDOW, STRIDE = 16, 8
#: Longer words are cut into pieces of so many characters.
WORD_CHARS = 16
#: Labelled documents to learn from, at most: toxic, other; candidates read for each, and their characters at most.
#: The shortest candidates are taken, up to TOTAL_CHARS by label.
SAMPLE, CANDIDATES, SAMPLE_CHARS, TOTAL_CHARS = (500, 700), 2, 6000, 700_000
#: The likest wrong candidates that join the sample for HARD_EPOCHS more.
HARD, HARD_EPOCHS = 300, 3
#: A small sample is run over until it has made LEAST_STEPS.
EPOCHS, RATE, BATCH_DOCS, LEAST_STEPS = 5, 0.01, 16, 320
CHARS, CHAR_DIM, CHAR_H, WORD_DIM, WORD_H = 96, 8, 8, 8, 8
THRESHOLD = 0.3
#: Words whose inputs a worker keeps.
TABLE_WORDS = 150_000
#: Windows, or words to learn, that run at once; words of a group of texts; bytes of a run of a long text.
AT_ONCE, GROUP_WORDS, RUN_BYTES = 4096, 100_000, 1 << 20


def pieces(text: str) -> list[str]:
    """A casefolded word without outer punctuation, in pieces of bounded length; often one."""
    if len(text) <= WORD_CHARS and text.isalnum():
        return [text]
    text = text.strip(string.punctuation)
    if text and not (text[0].isalnum() and text[-1].isalnum()):
        a, b = 0, len(text)
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        text = text[a:b]
    if len(text) <= WORD_CHARS:
        return [text] if text else []
    return [text[k : k + WORD_CHARS] for k in range(0, len(text), WORD_CHARS)]


def pieces_of(word: bytes) -> list[str]:
    """pieces() of a raw word."""
    return pieces(word.decode(errors="replace").casefold())


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(xg: np.ndarray, u: np.ndarray, mask: np.ndarray):
    """Run over (T, B, 3H) inputs; mask (T, B) is 0 where a state is carried on. States and a tape."""
    steps, batch, width = xg.shape
    h = np.zeros((batch, width // 3), dtype=xg.dtype)
    states, tape = [], []
    hd = width // 3
    for t in range(steps):
        a = h @ u
        zr = sigmoid(xg[t, :, : 2 * hd] + a[:, : 2 * hd])
        z, r = zr[:, :hd], zr[:, hd:]
        c = np.tanh(xg[t, :, 2 * hd :] + r * a[:, 2 * hd :])
        new = c + z * (h - c)
        m = mask[t][:, None]
        tape.append((h, z, r, c, a[:, 2 * hd :], m))
        h = h + m * (new - h)
        states.append(h)
    return np.stack(states), tape


def gru_back(dh_all: np.ndarray, tape, u: np.ndarray):
    """Gradients of inputs and of u, from gradients of all states."""
    du = np.zeros_like(u)
    dxg = np.zeros((len(tape), dh_all.shape[1], u.shape[1]), dtype=u.dtype)
    dh = np.zeros(dh_all.shape[1:], dtype=u.dtype)
    for t in range(len(tape) - 1, -1, -1):
        h, z, r, c, an, m = tape[t]
        dh = dh + dh_all[t]
        dnew = dh * m
        dh_prev = dh - dnew + dnew * z
        dz = dnew * (h - c) * z * (1 - z)
        dc = dnew * (1 - z) * (1 - c * c)
        dr = dc * an * r * (1 - r)
        dxg[t] = np.concatenate([dz, dr, dc], axis=1)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        du += h.T @ da
        dh = dh_prev + da @ u.T
    return dxg, du


class BiGru:
    """Names of one bidirectional GRU's parameters with attention pooling over its states."""

    def __init__(self, name: str):
        self.name = name

    def create(self, p: dict, rng, width: int, h: int) -> None:
        for d in "fb":
            p[f"{self.name}_w{d}"] = rng.normal(0, width**-0.5, (width, 3 * h)).astype(np.float32)
            p[f"{self.name}_u{d}"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            p[f"{self.name}_b{d}"] = np.zeros(3 * h, np.float32)
        p[f"{self.name}_a"] = rng.normal(0, 0.1, 2 * h).astype(np.float32)

    def forward(self, p: dict, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray):
        """gf, gb: (T, B, 3H) gate inputs of both directions. Pooled states (B, 2H) and a tape."""
        hf, tf = gru(gf, p[f"{self.name}_uf"], mask)
        hb, tb = gru(gb[::-1], p[f"{self.name}_ub"], mask[::-1])
        h = np.concatenate([hf, hb[::-1]], axis=2)
        score = h @ p[f"{self.name}_a"] + (mask - 1) * 1e4
        score = np.exp(score - score.max(axis=0))
        weight = score / score.sum(axis=0)
        pooled = (h * weight[:, :, None]).sum(axis=0)
        return pooled, (h, weight, tf, tb)

    def both_ways(self, p: dict, table: np.ndarray, at: np.ndarray, more: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """What attention and the rows of `more` (k, 2H) take of each state, apart by direction: (T, 2 + 2 * k, B), forward first.

        at (T, B): rows of the table (rows, 6H) of gate inputs of both directions. No tape: both directions
        run in one state with B along its last axis, so that each gate is contiguous. mask as in gru(), None for ones.
        """
        (steps, n), hd, k = at.shape, table.shape[1] // 6, len(more)
        # Rows of the matrix: update, reset and new gates, each of both directions; then what is taken.
        own, place = np.zeros((6 * hd + 2 + 2 * k, 2 * hd), np.float32), np.empty((2, 3, hd), np.int64)
        takes = np.concatenate([p[f"{self.name}_a"][None], more])
        for d, x in enumerate("fb"):
            part = slice(d * hd, (d + 1) * hd)
            place[d] = (2 * np.arange(3) + d)[:, None] * hd + np.arange(hd)
            own[place[d].reshape(-1), part] = p[f"{self.name}_u{x}"].T
            own[6 * hd + d, part] = takes[0, part]
            own[6 * hd + 2 + d * k : 6 * hd + 2 + (d + 1) * k, part] = takes[1:, part]
        forth, back = place.reshape(2, -1)
        h, a, g = np.zeros((2 * hd, n), np.float32), np.zeros((len(own), n), np.float32), np.empty((6 * hd, n), np.float32)
        out = np.empty((steps, 2 + 2 * k, n), np.float32)
        zr, c = a[: 4 * hd], a[4 * hd : 6 * hd]
        z, r = zr[: 2 * hd], zr[2 * hd :]
        forward = [(6 * hd, 0, 1), (6 * hd + 2, 2, k)]
        with np.errstate(over="ignore"):
            for t in range(steps):
                g[forth] = table[at[t], : 3 * hd].T
                g[back] = table[at[steps - 1 - t], 3 * hd :].T
                zr += g[: 4 * hd]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                c *= r
                c += g[4 * hd :]
                np.tanh(c, out=c)
                if mask is None:
                    h -= c
                    h *= z
                    h += c
                else:
                    new = c + z * (h - c)
                    h[:hd] += mask[t] * (new[:hd] - h[:hd])
                    h[hd:] += mask[steps - 1 - t] * (new[hd:] - h[hd:])
                np.matmul(own, h, out=a)
                for first, to, many in forward:
                    out[t, to : to + many] = a[first : first + many]
                    out[steps - 1 - t, to + many : to + 2 * many] = a[first + many : first + 2 * many]
        return out

    def backward(self, p: dict, g: dict, dpooled: np.ndarray, tape):
        h, weight, tf, tb = tape
        dweight = (h * dpooled).sum(axis=2)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        dh = weight[:, :, None] * dpooled + dscore[:, :, None] * p[f"{self.name}_a"]
        g[f"{self.name}_a"] = np.tensordot(dscore, h, ([0, 1], [0, 1]))
        k = h.shape[2] // 2
        dgf, g[f"{self.name}_uf"] = gru_back(dh[:, :, :k], tf, p[f"{self.name}_uf"])
        dgb, g[f"{self.name}_ub"] = gru_back(dh[::-1, :, k:], tb, p[f"{self.name}_ub"])
        return dgf, dgb[::-1]


CHAR, WORD = BiGru("char"), BiGru("word")


class Network:
    """Parameters, vocabulary and both passes."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        p = self.p = {}
        p["chars"] = rng.normal(0, 0.3, (CHARS + 1, CHAR_DIM)).astype(np.float32)
        p["words"] = np.zeros((len(vocabulary) + 1, WORD_DIM), np.float32)
        CHAR.create(p, rng, CHAR_DIM, CHAR_H)
        WORD.create(p, rng, WORD_DIM + 2 * CHAR_H, WORD_H)
        p["out"] = rng.normal(0, 0.3, 2 * WORD_H).astype(np.float32)
        p["bias"] = np.array([-3.0], np.float32)
        self.shift = 0.0

    def char_ids(self, words: list[str]) -> np.ndarray:
        """(T, n) character buckets; 0 where a word has ended."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros((size.max(), len(words)), np.int64)
        out[place, np.repeat(np.arange(len(words)), size)] = 1 + codes % CHARS
        return out

    def word_vectors(self, words: list[str], keep=None):
        """(n, width) vectors of words sorted by length, and a tape; short and long words run apart."""
        p, half = self.p, len(words) // 2
        pooled, tapes = [], []
        for part in (words[:half], words[half:]) if half else (words,):
            chars = self.char_ids(part)
            x = p["chars"][chars]
            out, tape = CHAR.forward(p, x @ p["char_wf"] + p["char_bf"], x @ p["char_wb"] + p["char_bb"], (chars > 0).astype(np.float32))
            pooled.append(out)
            tapes.append((chars, x, tape))
        own = np.array([self.vocabulary.get(w, 0) for w in words])
        if keep is not None:
            own = own * keep
        return np.concatenate([p["words"][own], np.concatenate(pooled)], axis=1), (tapes, own)

    def gates(self, words: list[str]) -> np.ndarray:
        """(n, 6H) inputs of both directions of the word network, for words of one length."""
        p, size = self.p, len(words[0])
        chars = 1 + np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size).T % CHARS
        table = np.concatenate([p["chars"] @ p["char_wf"] + p["char_bf"], p["chars"] @ p["char_wb"] + p["char_bb"]], axis=1)
        taken = CHAR.both_ways(p, table, chars, np.eye(2 * CHAR_H, dtype=np.float32))
        score = taken[:, 0] + taken[:, 1]
        score = np.exp(score - score.max(axis=0))
        score /= score.sum(axis=0)
        k = 2 + 2 * CHAR_H
        pooled = (score[:, None] * (taken[:, 2:k] + taken[:, k:])).sum(axis=0).T
        own = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        v = np.concatenate([p["words"][own], pooled], axis=1)
        return np.concatenate([v @ p["word_wf"] + p["word_bf"], v @ p["word_wb"] + p["word_bb"]], axis=1)

    def logits(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Logit of each window (B, T) of rows of the table; -1 pads."""
        at = np.ascontiguousarray(windows.T)
        mask = (at >= 0).astype(np.float32)
        out = self.p["out"]
        f, b, of, ob = np.moveaxis(WORD.both_ways(self.p, table, at, out[None], None if mask.all() else mask), 1, 0)
        score = f + b + (mask - 1) * 1e4
        score = np.exp(score - score.max(axis=0))
        return (score * (of + ob)).sum(axis=0) / score.sum(axis=0) + self.p["bias"][0]

    def step(self, docs: list[list[str]], labels: np.ndarray, rng) -> tuple[float, dict]:
        """Loss and gradients of a batch of documents, as lists of words."""
        p, g = self.p, {}
        words = sorted({w for d in docs for w in d}, key=lambda w: (len(w), w))
        place = {w: k for k, w in enumerate(words)}
        v, (tapes, own) = self.word_vectors(words, rng.random(len(words)) < 0.5)
        parts = [windows_of(np.array([place[w] for w in d])) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(w) for w in parts])
        at = np.concatenate(parts).T
        mask = (at >= 0).astype(np.float32)
        xv = v[at]
        pooled, tape = WORD.forward(p, xv @ p["word_wf"] + p["word_bf"], xv @ p["word_wb"] + p["word_bb"], mask)
        logit = pooled @ p["out"] + p["bias"][0]
        top = np.full(len(docs), -np.inf, np.float32)
        np.maximum.at(top, owner, logit)
        e = np.exp(logit - top[owner])
        total = np.bincount(owner, e, len(docs))
        soft = top + np.log(total)
        prob = sigmoid(soft)
        loss = -np.mean(np.where(labels == 1, np.log(prob + 1e-7), np.log(1 - prob + 1e-7)))
        dlogit = (((prob - labels) / len(docs))[owner] * e / total[owner]).astype(np.float32)
        g["bias"] = np.array([dlogit.sum()], np.float32)
        g["out"] = pooled.T @ dlogit
        dgf, dgb = WORD.backward(p, g, dlogit[:, None] * p["out"], tape)
        flat = xv.reshape(-1, xv.shape[2])
        dv = np.zeros_like(v)
        dx = np.zeros_like(flat)
        for d, dg in (("f", dgf), ("b", dgb)):
            dg = dg.reshape(-1, dg.shape[2])
            g[f"word_w{d}"], g[f"word_b{d}"] = flat.T @ dg, dg.sum(axis=0)
            dx += dg @ p[f"word_w{d}"].T
        live = at.reshape(-1) >= 0
        np.add.at(dv, at.reshape(-1)[live], dx[live])
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], own, dv[:, :WORD_DIM])
        g["words"][0] = 0
        g["chars"], first = np.zeros_like(p["chars"]), 0
        for chars, x, tape in tapes:
            some: dict[str, np.ndarray] = {}
            last = first + chars.shape[1]
            dcf, dcb = CHAR.backward(p, some, dv[first:last, WORD_DIM:], tape)
            first = last
            flat, dx = x.reshape(-1, CHAR_DIM), 0
            for d, dg in (("f", dcf), ("b", dcb)):
                dg = dg.reshape(-1, dg.shape[2])
                some[f"char_w{d}"], some[f"char_b{d}"] = flat.T @ dg, dg.sum(axis=0)
                dx = dx + dg @ p[f"char_w{d}"].T
            at = chars.reshape(-1)
            some["chars"] = np.stack([np.bincount(at, dx[:, k], CHARS + 1) for k in range(CHAR_DIM)], axis=1).astype(p["chars"].dtype)
            for k, x_ in some.items():
                g[k] = g[k] + x_ if k in g else x_
        return float(loss), g

    def fit(self, docs: list[list[str]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses, n = [], 0
        batches = max(1, -(-len(docs) // BATCH_DOCS))
        epochs = max(epochs, -(-LEAST_STEPS * epochs // (EPOCHS * batches)))
        for epoch in range(epochs):
            pace = rate * (1 - 0.8 * epoch / max(1, epochs - 1))
            loss = 0.0
            for some in np.array_split(rng.permutation(len(docs)), batches):
                value, g = self.step([docs[k] for k in some], labels[some], rng)
                n, loss = n + 1, loss + value
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, x in g.items():
                    x = x * min(1.0, 5 / (norm + 1e-9))
                    first[k] += 0.1 * (x - first[k])
                    second[k] += 0.01 * (x * x - second[k])
                    self.p[k] -= (pace * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
            losses.append(loss / batches)
        return losses


def windows_of(at: np.ndarray) -> np.ndarray:
    """All windows (n, WINDOW) over a sequence, the last one to its end; -1 pads a short text."""
    n = len(at)
    if n <= WINDOW:
        out = np.full((1, WINDOW), -1, np.int64)
        out[0, :n] = at
        return out
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts[-1] = min(starts[-1], n - WINDOW)
    return at[starts[:, None] + np.arange(WINDOW)]


class Scorer:
    """A trained network with the gate inputs of the words that a worker has met."""

    def __init__(self, network: Network):
        self.network = network
        self.empty()

    def empty(self) -> None:
        self.table = np.zeros((1024, 6 * WORD_H), np.float32)
        self.known: dict[bytes, int] = {}
        self.more: dict[bytes, list[int]] = {}
        self.rows: dict[str, int] = {}

    def learn(self, raw: list[bytes]) -> None:
        """Places for raw words: a row of the table, -1 for none, -2 for several (in `more`)."""
        if not raw:
            return
        parts = list(map(pieces, b"\n".join(raw).decode(errors="replace").casefold().split("\n")))
        by_size: dict[int, list[str]] = {}
        for x in dict.fromkeys(x for ps in parts for x in ps if x not in self.rows):
            by_size.setdefault(len(x), []).append(x)
        for new in by_size.values():
            for at in range(0, len(new), AT_ONCE):
                some = new[at : at + AT_ONCE]
                first = len(self.rows)
                if first + len(some) > len(self.table):
                    # What isn't filled yet takes no memory.
                    more = np.zeros((2 * (first + len(some)), self.table.shape[1]), np.float32)
                    more[:first] = self.table[:first]
                    self.table = more
                self.table[first : first + len(some)] = self.network.gates(some)
                self.rows.update(zip(some, range(first, first + len(some)), strict=True))
        for w, ps in zip(raw, parts, strict=True):
            self.known[w] = self.rows[ps[0]] if len(ps) == 1 else -2 if ps else -1
            if len(ps) > 1:
                self.more[w] = [self.rows[x] for x in ps]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table for words that have been learned."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(several := np.flatnonzero(at == -2)):
            rows = [self.more[words[k]] for k in several.tolist()]
            size = np.ones(len(at), np.int64)
            size[several] = list(map(len, rows))
            at = np.repeat(at, size)
            at[at == -2] = np.concatenate(rows)
        return at[at >= 0]

    def _group(self, group: list[tuple[int, list[bytes], int, bool]], top: np.ndarray) -> tuple[list[bytes], int]:
        """Windows of some runs of words, learned and run together; runs are (text, words, places to skip, ends the text).

        Returns what the run behind a last one that doesn't end its text starts with: words, and places to skip. So the
        windows of a text of several runs are those that it has as a whole.
        """
        held = dict.fromkeys(w for _, words, _, _ in group for w in words)
        new = [w for w in held if w not in self.known]
        if len(self.known) + len(new) > TABLE_WORDS:
            self.empty()
            new = list(held)
        self.learn(new)
        parts = [windows_of(self.places(words)[skip:]) for _, words, skip, _ in group]
        rest: tuple[list[bytes], int] = [], 0
        _, words, skip, ends = group[-1]
        if not ends:
            size = np.cumsum([len(self.more[w]) if self.known[w] == -2 else int(self.known[w] >= 0) for w in words])
            n = int(size[-1]) - skip if len(size) else 0
            whole = max(0, (n - WINDOW) // STRIDE + 1)
            parts[-1] = parts[-1][:whole]
            start = skip + max(0, whole - 1) * STRIDE
            first = int(np.searchsorted(size, start, "right"))
            rest = words[first:], start - (int(size[first - 1]) if first else 0)
        owner = np.repeat([k for k, _, _, _ in group], [len(w) for w in parts])
        windows = np.concatenate(parts)
        for at in range(0, len(windows), AT_ONCE):
            np.maximum.at(top, owner[at : at + AT_ONCE], self.network.logits(self.table, windows[at : at + AT_ONCE]))
        return rest

    def many(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores of whole texts, from the largest logit of all their windows."""
        top, group, n = np.full(len(texts), -np.inf), [], 0
        for k, text in enumerate(texts):
            words, skip = [], 0
            for more, ends in runs_of(text or b""):
                group.append((k, words + more, skip, ends))
                n += len(group[-1][1])
                words, skip = [], 0
                if n >= GROUP_WORDS or not ends:
                    words, skip = self._group(group, top)
                    group, n = [], 0
        if group:
            self._group(group, top)
        return sigmoid(top + self.network.shift)


def runs_of(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """A text's words in runs of at most about RUN_BYTES, and whether a run is the last."""
    at = 0
    while at + RUN_BYTES < len(text):
        stop = at + RUN_BYTES
        while stop < len(text) and not text[stop : stop + 1].isspace():
            stop += 1
        yield text[at:stop].split(), False
        at = stop
    yield text[at:].split(), True


def train(texts: list[str], labels: list[int], seed: int = 5) -> Network:
    """A network from labelled documents: the shortest of each label, then the others of label 0
    that it takes for 1. The shift puts THRESHOLD between the labels."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        network = Network({}, seed)
        network.p["out"][:] = 0
        network.shift = 2.0 if len(y) and y[0] else -2.0
        return network
    docs = [[x for w in t.encode().split() for x in pieces_of(w)] or ["-"] for t in texts]
    size = np.array([len(t) for t in texts])
    by_size = np.argsort(size, kind="stable")
    chosen = [by_size[y[by_size] == 1 - k][:n] for k, n in enumerate(SAMPLE)]
    first = np.concatenate([c[np.cumsum(size[c]) <= TOTAL_CHARS] for c in chosen])
    count = Counter(w for k in first for w in set(docs[k]))
    often = sorted((w for w, n in count.items() if n >= 4), key=lambda w: (-count[w], w))[:10_000]
    network = Network({w: k + 1 for k, w in enumerate(often)}, seed)
    network.fit([docs[k] for k in first], y[first])
    raw = [t.encode() for t in texts]
    scores = Scorer(network).many(raw)
    rest = np.setdiff1d(np.flatnonzero(y == 0), first)
    hard = rest[np.argsort(-scores[rest], kind="stable")][:HARD]
    again = np.concatenate([first, hard])
    network.fit([docs[k] for k in again], y[again], HARD_EPOCHS, rate=RATE / 3)
    s = np.clip(Scorer(network).many(raw), 1e-9, 1 - 1e-9)
    s = np.log(s / (1 - s))
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order]
    wrong = np.cumsum(np.r_[0, y]) + ((1 - y).sum() - np.cumsum(np.r_[0, 1 - y]))
    edges = np.r_[s[0] - 1, (s[1:] + s[:-1]) / 2, s[-1] + 1]
    best = np.flatnonzero(wrong == wrong.min())
    network.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - edges[best[len(best) // 2]])
    return network


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on the labelled rows that aren't held out: a bounded sample in order of a hash of doc_id."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic in (0, 1)"
    ).filter(~held_out())
    chosen = [
        known.filter(F.col("toxic") == 1 - k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n * CANDIDATES) for k, n in enumerate(SAMPLE)
    ]
    ids = {r.doc_id: r.toxic for d in chosen for r in d.collect()}
    if not ids:
        return train([], [])
    pick = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .filter(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(pick), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(len(ids))
        .collect()
    )
    return train([r.text for r in rows], [ids[r.doc_id] for r in rows])


def _scored(model, schema_names: list[str] | None, column: str):
    """Scores by document, or with schema_names None the rows that stay below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.made("toxicity", Scorer)
        for batch in batches:
            texts = byte_texts(batch.column(batch.schema.names.index(column)))
            scores = scorer.many(texts)
            if schema_names is None:
                yield batch.filter(pa.array(scores < THRESHOLD))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], schema_names)

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    Null and empty texts are scored as a text without words. Rows with a null doc_id aren't held
    out. Without labels of both kinds every score is the same. Repeated rows score alike; an empty
    table gives an empty result; columns but doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    model = Published(docs.sparkSession, learned(docs, labels))
    run = _scored(model, ["doc_id", "held_out", "score", "predicted"], "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score stays below the threshold stay as they are."""
    prepare(spark)
    model = Published(spark, learned(docs, read_table(spark, sf_dir, "labels")))
    return docs.mapInArrow(_scored(model, None, "text"), docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
