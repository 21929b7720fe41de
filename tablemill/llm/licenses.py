"""License scans: a trained paragraph classifier whose predictions a template comparison confirms.

A text's words are read as one stream, whatever its line ends, in overlapping segments of two
lengths. Sparse word uni- and bigrams feed a multinomial logistic regression over licence families
and an unknown class. It learns from the families' wordings with words of the corpus around them,
and from a bounded sample of the corpus's own segments as unknown. Temperature and margin of the
unknown class are fitted on held-back wordings: whole phrases, identifiers and paragraphs that the
classifier of that fold has never seen in any form. A prediction counts only where the text holds
enough word trigrams of one of its family's templates in a row; the place is that of the template,
so several notices of a line, and one that runs over several lines, are all found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import Published, byte_texts, mixed, prepare, read_table, shared
from tablemill.llm.decontaminate import NormalHashes, normal_words
from tablemill.llm.license_texts import OTHER, wordings

#: Words of a segment and the step to the next one.
SEGMENTS = ((12, 6), (48, 24))
#: Words of a template and the step to the next one; a longer wording is several templates.
TEMPLATE, TEMPLATE_STEP = 24, 12
#: Hashed features, documents whose segments are learned as unknown, segments of each, passes, and folds to calibrate.
FEATURES, SAMPLE, SAMPLE_SEGMENTS, PASSES, FOLDS = 1 << 16, 500, 6, 4, 3
#: Share of a template's trigrams that confirms, and the probability that a family needs at least beside its being likelier than unknown.
CONFIRM, POSSIBLE = 0.5, 0.1


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64) % FEATURES


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def features(h: np.ndarray) -> np.ndarray:
    """Places of a segment's unigrams and bigrams."""
    return features_of(np.concatenate([mixed(h), pairs_of(h)]))


def grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word trigrams, then of word pairs, and the place of each one's first word. A text of two words has a pair only."""
    pairs = mixed(pairs_of(h) + np.uint64(2)) if len(h) > 1 else h[:0]
    threes = mixed(h[:-2] * np.uint64(0xD6E8FEB86659FD93) + pairs_of(h)[1:]) if len(h) > 2 else h[:0]
    return np.concatenate([threes, pairs]), np.concatenate([np.arange(len(threes)), np.arange(len(pairs))])


def template_grams(h: np.ndarray) -> frozenset:
    """What stands for a template: its trigrams, or the pair of a template of two words."""
    return frozenset(grams(h)[0][: max(1, len(h) - 2)].tolist())


def segments(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of all segments of a text of n words; the last one of each length ends with the text."""
    first, last = [], []
    for size, step in SEGMENTS:
        at = np.minimum(np.arange(0, max(1, n - size + step), step), max(0, n - size))
        first.append(at)
        last.append(np.minimum(at + size, n))
    return np.concatenate(first), np.concatenate(last)


class Templates:
    """Pieces of the wordings with the trigrams by which they are found."""

    def __init__(self, known: dict[str, list[np.ndarray]]):
        self.family, self.length, self.words, rows = [], [], [], {}
        for k, words in enumerate(known.values(), 1):
            seen = set()
            for h in words:
                stops = range(0, max(1, len(h) - TEMPLATE + TEMPLATE_STEP), TEMPLATE_STEP)
                for at in stops:
                    t = template_grams(h[max(0, min(at, len(h) - TEMPLATE)) : at + TEMPLATE])
                    if t and t not in seen:
                        seen.add(t)
                        for x in t:
                            rows.setdefault(x, []).append(len(self.family))
                        self.family.append(k)
                        self.length.append(len(t))
                        self.words.append(min(3, len(h)))
        self.of = rows
        self.hashes = np.array(sorted(rows), dtype=np.uint64)
        self.most = max(self.length)

    def confirmed(self, h: np.ndarray, first: int, last: int) -> dict[int, tuple[float, int, int]]:
        """By family: the share of the most complete template in these words, its first word and its end."""
        own, place = grams(h[first:last])
        spot = np.searchsorted(self.hashes, own)
        at = np.flatnonzero(self.hashes[np.minimum(spot, len(self.hashes) - 1)] == own)
        where: dict[int, dict[int, int]] = {}
        for p, x in zip(place[at].tolist(), own[at].tolist(), strict=True):
            for t in self.of[x]:
                where.setdefault(t, {}).setdefault(x, p)
        out: dict[int, tuple[float, int, int]] = {}
        for t, found in where.items():
            like, places = len(found) / self.length[t], found.values()
            new = (like, first + min(places), min(last, first + max(places) + self.words[t]))
            if like >= CONFIRM and (new[0], -new[1]) > (lambda o: (o[0], -o[1]))(out.get(self.family[t], (0.0, 0, 0))):
                out[self.family[t]] = new
        return out


class Classifier:
    """known: wordings with their kinds by family; unknown: texts of segments that hold no notice."""

    def __init__(self, unknown: list[str], known: dict[str, list[tuple[str, str]]] | None = None, seed: int = 9):
        memo = NormalHashes()
        hashed = lambda t: normal_words(t.encode(), memo)
        known = known or wordings()
        self.families = ["unknown", *known]
        words = {f: [(hashed(t), kind) for t, kind in ts] for f, ts in known.items()}
        self.templates = Templates({f: [h for h, _ in ts] for f, ts in words.items()})
        plain = [h for h in map(hashed, [*unknown, *OTHER]) if len(h)]
        fold_of = lambda kind: zlib.crc32(kind.encode()) % FOLDS
        held, truth = [], []
        for fold in range(FOLDS):
            rng = np.random.default_rng(seed + fold)
            inner = {f: [h for h, kind in ts if fold_of(kind) != fold] for f, ts in words.items()}
            outer = {f: [h for h, kind in ts if fold_of(kind) == fold] for f, ts in words.items()}
            self._fit(*self._rows(inner, [h for k, h in enumerate(plain) if k % FOLDS != fold], rng), rng)
            rows, labels = self._rows(outer, [h for k, h in enumerate(plain) if k % FOLDS == fold], rng, 2)
            held += [self.logits(x) for x in rows]
            truth += labels
        self.heat, self.margin = self._calibrated(np.array(held), np.array(truth))
        rng = np.random.default_rng(seed)
        self._fit(*self._rows({f: [h for h, _ in ts] for f, ts in words.items()}, plain, rng), rng)

    def _calibrated(self, logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Temperature and margin of the unknown class with the least log loss on wordings that were held back.

        Classes weigh the same, but unknown as much as all families together.
        """
        share = np.bincount(y, minlength=len(self.families)).clip(1)
        weight = np.where(y == 0, 1 / share[0], 1 / (share[y] * max(1, len(self.families) - 1)))

        def loss(heat: float, margin: float) -> float:
            x = logits / heat
            x[:, 0] += margin
            return float(-(weight * np.log(self.soft(x)[np.arange(len(y)), y] + 1e-9)).sum())

        grid = [(h, m) for h in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0) for m in np.arange(-3, 3.25, 0.25).tolist()]
        return min(grid, key=lambda x: (loss(*x), x))

    def _rows(self, known: dict[str, list[np.ndarray]], plain: list[np.ndarray], rng, variants: int = 3):
        """Features and labels: segments of wordings, alone and with words of unknown segments around them."""
        rows, labels = [], []
        size = max(s for s, _ in SEGMENTS)
        for family, words in known.items():
            for h in words:
                for v in range(variants):
                    x = h
                    if v and plain:
                        extra = plain[rng.integers(len(plain))]
                        n = int(rng.integers(0, 1 + min(len(extra), max(0, SEGMENTS[0][0] - len(h)))))
                        cut = int(rng.integers(0, n + 1))
                        x = np.concatenate([extra[:cut], h, extra[cut:n]])
                    for a, b in zip(*(e.tolist() for e in segments(len(x))), strict=True) if len(x) > SEGMENTS[0][0] else [(0, len(x))]:
                        rows.append(features(x[a:b]))
                        labels.append(self.families.index(family))
        for h in plain:
            for a in {0, *(int(rng.integers(0, max(1, len(h) - 5))) for _ in range(2))}:
                rows.append(features(h[a : a + (size if a == 0 else SEGMENTS[0][0])]))
                labels.append(0)
        return rows, labels

    @staticmethod
    def soft(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def logits(self, at: np.ndarray) -> np.ndarray:
        return self.w[at].sum(axis=0) / max(1, len(at)) ** 0.5 + self.b

    def _fit(self, rows: list[np.ndarray], labels: list[int], rng) -> None:
        """Adagrad on the log loss; each class weighs the same."""
        y, n = np.array(labels), len(self.families)
        self.w, self.b = np.zeros((FEATURES, n), np.float32), np.zeros(n, np.float32)
        weight = np.minimum(3.0, len(y) / (n * np.bincount(y, minlength=n).clip(1)))[y]
        past, past_b = np.full_like(self.w, 1e-3), np.full_like(self.b, 1e-3)
        places = [np.unique(x) for x in rows]
        for _ in range(PASSES):
            for k in rng.permutation(len(rows)):
                g = self.soft(self.logits(rows[k]))
                g[y[k]] -= 1
                g *= weight[k]
                gw = g / max(1, len(rows[k])) ** 0.5
                u = places[k]
                past[u] += gw**2
                self.w[u] -= 0.5 * gw / np.sqrt(past[u])
                past_b += g**2
                self.b -= 0.1 * g / np.sqrt(past_b)

    def scan(self, h: np.ndarray) -> list[tuple[str, float, float, int, int]]:
        """(family, probability, template similarity, first word, words) of the confirmed notices of a text, in order.

        Class scores of all words and word pairs are summed up once, so a segment's score is a
        difference of sums, whatever the segments' overlap. Of notices at one place the one with the
        most probability times similarity counts; ties go to the family that comes first. Families share
        no word, templates of one family up to half of theirs.
        """
        if not len(h):
            return []
        first, last = segments(len(h))
        sums = np.zeros((len(h) + 1, len(self.families)))
        np.cumsum(self.w[features_of(mixed(h))], axis=0, dtype=np.float64, out=sums[1:])
        pair_sums = np.zeros((len(h), len(self.families)))
        np.cumsum(self.w[features_of(pairs_of(h))], axis=0, dtype=np.float64, out=pair_sums[1:])
        n = 2 * (last - first) - 1
        logits = ((sums[last] - sums[first] + pair_sums[last - 1] - pair_sums[first]) / np.sqrt(n)[:, None] + self.b) / self.heat
        logits[:, 0] += self.margin
        likely = np.flatnonzero(logits[:, 1:].max(axis=1) >= logits[:, 0])
        found: dict[tuple[int, int], tuple[float, float, int]] = {}
        for k, p in zip(likely.tolist(), self.soft(logits[likely]), strict=True):
            reach = TEMPLATE
            for f, (like, a, b) in self.templates.confirmed(h, max(0, first[k] - reach), min(len(h), last[k] + reach)).items():
                old = found.get((f, a), (0.0, 0.0, 0))
                if p[f] >= POSSIBLE and p[f] * like > old[0] * old[1]:
                    found[f, a] = (float(p[f]), like, b)
        taken: list[tuple[int, int, int, float, float]] = []
        for (f, a), (p, like, b) in sorted(found.items(), key=lambda x: (-x[1][0] * x[1][1], x[0])):
            if all((2 if f == g else 1 + b - a + d - c) * (min(b, d) - max(a, c)) <= min(b - a, d - c) for g, c, d, _, _ in taken):
                taken.append((f, a, b, p, like))
        out: list[list] = []
        for f, a, b, p, like in sorted(taken, key=lambda x: (x[1], x[2])):
            if out and out[-1][0] == f and a < out[-1][2]:
                out[-1][2:] = [max(b, out[-1][2]), max(p, out[-1][3]), max(like, out[-1][4])]
            else:
                out.append([f, a, b, p, like])
        return [(self.families[f], p, like, a, b - a) for f, a, b, p, like in out]


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier, memo = model.made("licenses", _same), shared("licenses", ("normal",), NormalHashes)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                lines = [normal_words(line, memo) for line in (text or b"").split(b"\n")]
                start = np.cumsum([0, *map(len, lines)])
                for family, p, like, at, n in classifier.scan(np.concatenate(lines)):
                    rows.append((doc_id, int(np.searchsorted(start, at, "right")) - 1, family, p, like, at, n))
            c = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], ["doc_id", "paragraph", "family", "probability", "similarity", "first_word", "n_words"])

    return run


def _same(x):
    return x


def _some_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to some segments of the whole text, chosen by a hash of doc_id."""
    size = max(s for s, _ in SEGMENTS)
    for batch in batches:
        ids, out = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or "").split()
            rng = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
            for k, a in enumerate(sorted(set(rng.integers(0, max(1, len(words) - size + 1), SAMPLE_SEGMENTS).tolist()))):
                ids.append(SAMPLE_SEGMENTS * k)
                out.append(" ".join(w[:64] for w in words[a : a + size]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["k", "segment"])


def unknown_segments(docs: DataFrame) -> list[str]:
    """At most SAMPLE * SAMPLE_SEGMENTS segments without words of licences, from anywhere in the whole texts of SAMPLE documents.

    The documents are the first in order of a hash of doc_id; only ids go to the driver before they
    are chosen. They are learned from without labels, as text that holds no notice, so a segment with a word of licences is left out.
    """
    spark = docs.sparkSession
    ids = [r.doc_id for r in docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    picked = spark.createDataFrame([(i,) for i in sorted(set(ids))], "doc_id long")
    rows = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_some_segments, "k long, segment string")
    plain = rows.filter("not lower(segment) rlike 'licen[cs]|permission|redistribut|copyright|spdx|public domain'")
    return [r.segment for r in plain.orderBy(F.xxhash64("segment"), "segment").limit(SAMPLE * SAMPLE_SEGMENTS).collect()]


def licenses(docs: DataFrame, known: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, first_word, n_words): the licence notices of each text.

    paragraph is the line that holds the notice's first word, first_word its place among the text's
    words (those that are more than punctuation); a notice may run over several lines, and a line
    may hold several. Templates of a family that overlap give one row. known replaces the wordings. Null
    texts are empty; repeated rows give repeated rows; an empty table gives an empty result; columns
    but doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = Published(spark, Classifier(unknown_segments(rows), known))
    return rows.mapInArrow(_scan(model), "doc_id long, paragraph int, family string, probability double, similarity double, first_word int, n_words int")


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return licenses(read_table(spark, sf_dir, "documents"))
