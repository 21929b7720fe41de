"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary is a trie of pieces that start a word and pieces that go on inside it. Each node
has a failure link and the number of pieces popped on the way there: when no edge fits the next
byte, the longest match up to here is popped by following the link, so every byte is read once and
only a count is kept, never a piece (linear-time MaxMatch, Song et al. 2021).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.bpe import byte_alphabet, load_vocabulary
from tablemill.llm.common import Memo, byte_texts, prepare, read_table


class LongestMatch:
    """Greedy word-piece lengths: initial pieces start a word, inner pieces follow.

    Nodes are numbers; node 0 is the root of initial pieces, node 1 that of inner pieces. fail is -1
    where nothing can be popped, and popped counts the pieces that the link pops.
    """

    def __init__(self, initial: list[bytes], inner: list[bytes]):
        self.edges: dict[int, int] = {}
        ends = [False, False]
        for start, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                at = start
                for b in piece:
                    key = at << 8 | b
                    if key not in self.edges:
                        self.edges[key] = len(ends)
                        ends.append(False)
                    at = self.edges[key]
                if piece:
                    ends[at] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.edges.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        level = [0, 1]
        while level:
            deeper = []
            for parent in level:
                for b, node in below.get(parent, ()):
                    deeper.append(node)
                    if ends[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    at, popped = self.fail[parent], self.popped[parent]
                    while at >= 0 and (at << 8 | b) not in self.edges:
                        popped, at = popped + self.popped[at], self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.edges[at << 8 | b], popped

            level = deeper

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (the unknown token) if it can't be split."""
        at, n, edges, fail, popped = 0, 0, self.edges, self.fail, self.popped
        for b in word:
            while (down := edges.get(at << 8 | b)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = down
        while at > 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


def vocabulary_pieces(file: bytes) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary: those with a leading space start words, the others go on inside."""
    alphabet = byte_alphabet()
    pieces = [bytes(alphabet[c] for c in text) for text in json.loads(file)["model"]["vocab"]]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


class WordCounts(Memo):
    """Piece counts of words, which stand behind a space."""

    def __init__(self, file: bytes):
        super().__init__()
        self.automaton = LongestMatch(*vocabulary_pieces(file))

    def make(self, word: bytes) -> int:
        return self.automaton.count(b" " + word)


def _counted(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.made("token_counts", WordCounts).__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in byte_texts(batch.column(1)):
                parts = (text or b"").split()
                words.append(len(parts))
                tokens.append(sum(map(get, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each whole text: words between ASCII white space, greedy longest pieces.

    Null and empty texts have no words. Rows repeat as they come; an empty table gives an empty
    result; columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counted(load_vocabulary(spark, path)), "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
