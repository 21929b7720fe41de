"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

A text goes through `Stream` in slices; what a slice leaves undecided is held, and everything else
leaves as ids at once. Two lookaheads decide:

* The pre-tokenizer's. A piece stands once SETTLED characters behind it are known, so the pieces of
  a slice up to there are merged whole (through a bounded memo, new ones in bulk).
* That of the merge list, for the piece that a slice cuts. BPE merges the pair of least rank first,
  so what follows a token can undo it only through a merge (p, q) that starts at the token's end: p
  must be a suffix that the token had while it was built (its right spine), and q must itself have
  survived until that merge, which again depends only on merges of lower rank. Ranks fall along such
  a chain, so the merge list alone bounds how many bytes behind a token decide it:
  `MergeList.lookahead`, at most `MergeList.sufficient` from the token's start. `Transducer` holds
  at most a window of twice that. Most tokens stand earlier: in the whole text some token starts
  at a place from which the held bytes are the beginning of a token, and the tokens before that
  place are those of the bytes before it. What the merges of all such beginnings share is stable.

Decoding. Token bytes go through an incremental UTF-8 decoder, a state machine that keeps at most
three bytes of an unfinished character; each bad sequence becomes U+FFFD. Both digests are updated
while the ids stream by, so beside the text itself no memory grows with it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablemill.llm.common import Memo, Published, columns_of, prepare, read_table

#: The pre-tokenizer's published pattern. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are fed at once, and pieces that a worker's memo holds.
SLICE, MEMO_PIECES = 1 << 13, 150_000
#: Bytes up to which merges are found by scanning, and in bulk; beyond them by a heap.
LONG_PIECE = 48
#: Characters of the piece that a slice cuts from which it goes on as an open piece, byte by byte.
OPEN_PIECE = 8
#: Between other characters a single space starts a piece, so a text without this can be cut before each space.
NEAR_SPACE = re.compile(r"\s | \s")
#: Longer texts come up with their new segments one by one.
PRIMED = 1 << 16
#: Tokens that are decoded at once.
DECODE_AT_ONCE = 1 << 15
#: A piece ends for sure if this many characters follow it: a contraction has three.
SETTLED = 3


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeList:
    """Ranked merges over byte tokens, with the lookahead that they need.

    merges: (left id, right id, merged id) by rank; token_bytes: bytes by id; byte_ids: id by byte.
    """

    def __init__(self, merges: list[tuple[int, int, int]], token_bytes: list[bytes], byte_ids: list[int]):
        self.token_bytes, self.byte_ids = token_bytes, byte_ids
        self.merges = merges

    @cached_property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(rank, merged id) by pair of ids."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b, c) in enumerate(self.merges):
            found.setdefault((a, b), (rank, c))
        return found

    @cached_property
    def lookahead(self) -> list[int]:
        """By token id: how many bytes behind the token decide whether it stands."""
        size = len(self.token_bytes)
        right = [[] for _ in range(size)]
        for _, b, c in self.merges:
            right[c].append(b)
        longest = [0] * size
        spines: list[list[int] | None] = [None] * size

        def spine(t: int) -> list[int]:
            if spines[t] is None:
                found, todo = [], [t]
                while todo:
                    x = todo.pop()
                    if x not in found:
                        found.append(x)
                        todo += right[x]
                spines[t] = found
            return spines[t]

        for a, b, _ in self.merges:
            reach = len(self.token_bytes[b]) + max(longest[p] for p in spine(b))
            longest[a] = max(longest[a], reach)
        return [max(longest[p] for p in spine(t)) for t in range(size)]

    @cached_property
    def sufficient(self) -> int:
        """Bytes from a token's start that settle it, whatever the token."""
        return max(len(b) + n for b, n in zip(self.token_bytes, self.lookahead, strict=True))

    @property
    def window(self) -> int:
        return 2 * self.sufficient

    @cached_property
    def _sorted(self) -> list[bytes]:
        return sorted(self.token_bytes)

    @cached_property
    def _longest(self) -> int:
        return max(map(len, self.token_bytes))

    def begins_token(self, data: bytes) -> bool:
        """Whether a longer token begins with data."""
        k = bisect_right(self._sorted, data)
        return k < len(self._sorted) and self._sorted[k].startswith(data)

    def stable(self, data: bytes) -> list[int]:
        """The first tokens of data that stand whatever follows."""
        n, shared = len(data), None
        for e in range(n, max(-1, n - self._longest), -1):
            if e < n and not self.begins_token(data[e:]):
                continue
            tokens = self.merge(data[:e])
            if shared is None:
                shared = tokens
            else:
                k = 0
                while k < min(len(shared), len(tokens)) and shared[k] == tokens[k]:
                    k += 1
                shared = shared[:k]
            if not shared:
                return []
        return shared or []

    def merge(self, data: bytes) -> list[int]:
        """All merges inside data."""
        if len(data) <= LONG_PIECE:
            return np.frombuffer(self.short(data), dtype="<u4").tolist()
        return self._long([self.byte_ids[b] for b in data])

    @cached_property
    def _letters(self) -> tuple[str, dict, list]:
        """Tokens as single characters: those of bytes; rank by pair; (pair, merged) by rank."""
        char = lambda k: chr(k if k < 0xD800 else k + 0x800)
        ranks: dict[tuple[str, str], int] = {}
        rules = []
        for rank, (a, b, c) in enumerate(self.merges):
            ranks.setdefault((char(a), char(b)), rank)
            rules.append((char(a) + char(b), char(c)))
        return "".join(char(k) for k in self.byte_ids), ranks, rules

    def short(self, data: bytes) -> bytes:
        """All merges inside a few bytes; ids as little-endian 32-bit bytes."""
        letters, ranks, rules = self._letters
        text, get, none = "".join([letters[b] for b in data]), ranks.get, repeat(len(rules))
        while len(text) > 1:
            best = min(map(get, zip(text, text[1:]), none))  # noqa: B905
            if best == len(rules):
                break
            text = text.replace(*rules[best])
        ids = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        return (ids - 0x800 * (ids > 0xD800)).astype("<u4").tobytes() if self._high else ids.tobytes()

    @cached_property
    def _high(self) -> bool:
        return len(self.token_bytes) > 0xD800

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pair keys with their ranks, merged ids by rank, and ranks of byte pairs."""
        keys = {}
        for rank, (a, b, _) in enumerate(self.merges):
            keys.setdefault(a << 32 | b, rank)
        pairs = np.array(sorted(keys), dtype=np.int64)
        ranks = np.array([keys[k] for k in pairs.tolist()] + [len(self.merges)], dtype=np.int32)
        merged = np.array([c for _, _, c in self.merges], dtype=np.int64)
        of_bytes = np.array([[keys.get(a << 32 | b, len(self.merges)) for b in self.byte_ids] for a in self.byte_ids], dtype=np.int32)
        return pairs, ranks, merged, of_bytes

    def bulk(self, data: list[bytes]) -> list[bytes]:
        """short() of many pieces of 1 to LONG_PIECE bytes: one merge of each piece a round."""
        out: list[bytes] = [b""] * len(data)
        order = sorted(range(len(data)), key=lambda k: len(data[k]))
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            for k, ids in zip(some, self._rounds([data[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _rounds(self, data: list[bytes]) -> list[bytes]:
        pairs, ranks, merged, of_bytes = self._tables
        none, size, width = len(self.merges), np.array([len(d) for d in data]), max(map(len, data)) + 1
        flat = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), dtype=np.uint8).reshape(-1, width)
        ids = np.array(self.byte_ids, dtype=np.int64)[flat]
        rank = of_bytes[flat[:, :-1], flat[:, 1:]]
        rank[np.arange(width - 1) >= size[:, None] - 1] = none
        done = np.full((len(data), width), 0, dtype="<u4")
        live, left = np.arange(len(data)), size.copy()
        shift = np.arange(width)
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            best = rank[row, at]
            stay = best < none
            if not stay.all():
                done[live[~stay]] = ids[~stay]
                live, left, ids, rank, at, best = live[stay], left[stay], ids[stay], rank[stay], at[stay], best[stay]
                row = np.arange(len(live))
                if not len(live):
                    break
            source = np.minimum(shift + (shift > at[:, None]), width - 1)
            ids = ids[row[:, None], source]
            ids[row, at] = merged[best]
            rank = rank[row[:, None], np.minimum(source[:, :-1], width - 2)]
            left = left - 1
            size[live] = left
            for j in (at - 1, at):
                key = ids[row, np.maximum(j, 0)] << 32 | ids[row, np.maximum(j, 0) + 1]
                spot = np.searchsorted(pairs, key)
                hit = (j >= 0) & (j < left - 1) & (pairs[np.minimum(spot, len(pairs) - 1)] == key)
                new = np.where(hit, ranks[np.minimum(spot, len(pairs))], none)
                rank[row[j >= 0], j[j >= 0]] = new[j >= 0]
            rank[row, np.minimum(left - 1, width - 2)] = none
        bytes_, ends = done[np.arange(width) < size[:, None]].tobytes(), np.cumsum(size) * 4
        return [bytes_[e - 4 * n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]

    def _long(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(f[0], k, ids[k], ids[k + 1], f[1]) for k in range(n - 1) if (f := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if f := get((new, ids[after[k]])):
                    heapq.heappush(heap, (f[0], k, new, ids[after[k]], f[1]))
            if before[k] >= 0 and (f := get((ids[before[k]], new))):
                heapq.heappush(heap, (f[0], before[k], ids[before[k]], new, f[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """Feeds on bytes of one piece, emits the tokens that nothing to come can change."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, b""
        #: Tokens emitted before their piece had ended.
        self.early = 0

    def feed(self, data: bytes, last: bool = False) -> Iterator[int]:
        m, at = self.merges, 0
        while at < len(data) or last:
            room = m.window - len(self.held)
            self.held += data[at : at + room]
            at += room
            if last and at >= len(data):
                yield from m.merge(self.held)
                self.held = b""
                return
            end = 0
            if len(self.held) < m.window:
                for token in m.stable(self.held):
                    self.early += 1
                    yield token
                    end += len(m.token_bytes[token])
                self.held = self.held[end:]
                return
            for token in m.merge(self.held):
                stop = end + len(m.token_bytes[token])
                if stop + m.lookahead[token] > len(self.held):
                    break
                self.early += 1
                yield token
                end = stop
            self.held = self.held[end:]


class Pieces(Memo):
    """Ids of a piece of the pre-tokenizer, as little-endian 32-bit bytes."""

    def __init__(self, merges: MergeList, size: int = MEMO_PIECES):
        super().__init__(size)
        self.merges = merges

    def make(self, piece: str) -> bytes:
        data = piece.encode()
        return self.merges.short(data) if len(data) <= LONG_PIECE else np.array(self.merges.merge(data), dtype="<u4").tobytes()


class Segments(Memo):
    """Ids of a single space and the text up to the next one, as little-endian 32-bit bytes."""

    def __init__(self, pieces: Pieces, pattern, size: int = MEMO_PIECES):
        super().__init__(size)
        self.pieces, self.pattern = pieces, pattern

    def make(self, segment: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(" " + segment)))


#: The rest of an open piece by its kind, and what opens one. White space lets its last character go to the next piece.
GOES_ON = {k: regex.compile(p) for k, p in (("letters", r"\p{L}*+"), ("numbers", r"\p{N}*+"), ("others", r"[^\s\p{L}\p{N}]*+"), ("space", r"\s*+"))}
OPENS = {k: regex.compile(p) for k, p in (("letters", r" ?\p{L}++"), ("numbers", r" ?\p{N}++"), ("others", r" ?[^\s\p{L}\p{N}]++"), ("space", r"\s\s++"))}


def _plain(char: str) -> bool:
    return char.isalnum() or "!" <= char <= "~"


class Stream:
    """The pre-tokenizer's state machine over slices of a text: ids leave once they are settled.

    It holds less than SETTLED + OPEN_PIECE characters behind the last settled piece, or an open
    piece's window of bytes.
    """

    def __init__(self, codec: Codec):
        self.codec, self.tail, self.kind, self.machine = codec, "", None, Transducer(codec.merges)

    def _open(self, piece: str, last: bool = False) -> Iterator[bytes]:
        machine, before = self.machine, self.machine.early
        ids = np.fromiter(machine.feed(piece.encode(), last), dtype="<u4")
        self.codec.early += machine.early - before
        yield ids.tobytes()

    def feed(self, text: str, last: bool = False) -> Iterator[bytes]:
        """Runs of ids as little-endian 32-bit bytes; last: nothing follows."""
        text = self.tail + text
        self.tail = ""
        if self.kind:
            stop = GOES_ON[self.kind].match(text).end()
            more = stop == len(text) and not last
            if self.kind == "space" and (more or stop < len(text)):
                stop -= 1
                if more:
                    self.tail = text[stop:]
            yield from self._open(text[:stop], last=not more)
            if more:
                return
            self.kind, text = None, text[stop:]
        if last:
            yield from self.codec.settled(text)
            return
        cut = text.rfind(" ", 1, len(text) - 1)
        if cut > 0 and _plain(text[cut - 1]) and _plain(text[cut + 1]):
            yield from self.codec.settled(text[:cut])
        else:
            cut = 0
        pieces, at = [], cut
        for m in self.codec.pattern.finditer(text, cut):
            if m.end() > len(text) - SETTLED:
                break
            pieces.append(m.group())
            at = m.end()
        yield b"".join(map(self.codec.pieces.__getitem__, pieces))
        text = text[at:]
        if len(text) >= OPEN_PIECE:
            for kind, opens in OPENS.items():
                if opens.fullmatch(text):
                    self.kind = kind
                    if kind == "space":
                        text, self.tail = text[:-1], text[-1]
                    yield from self._open(text)
                    return
        self.tail = text


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary file (its JSON as bytes)."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        table = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, k in vocab.items():
            table[k] = bytes(alphabet[c] for c in text)
        byte_ids = [0] * 256
        for char, b in alphabet.items():
            byte_ids[b] = vocab[char]
        merges = []
        for x in spec["model"]["merges"]:
            a, b = x.split(" ") if isinstance(x, str) else x
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.merges = MergeList(merges, table, byte_ids)
        self.table = list(table)
        for text, k in self.special.items():
            self.table[k] = text.encode()
        self.pieces = Pieces(self.merges)
        #: Tokens that left a piece before its end was known.
        self.early = 0
        self.pattern = regex.compile(PATTERN)
        self.segments = Segments(self.pieces, self.pattern)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def prime(self, texts: list[str]) -> None:
        """Put the new segments of some texts into the memo, with all their merges run together."""
        segments = self.segments
        new = {x for t in texts if len(t) <= PRIMED for x in t.split(" ")[1:] if x not in segments and x not in segments.old}
        parts = {x: [" " + x] if x.isalpha() else self.pattern.findall(" " + x) for x in new}
        pieces = list({p for ps in parts.values() for p in ps if p not in self.pieces and p not in self.pieces.old})
        data = [p.encode() for p in pieces]
        short = [k for k, d in enumerate(data) if len(d) <= LONG_PIECE]
        self.pieces.put({pieces[k]: ids for k, ids in zip(short, self.merges.bulk([data[k] for k in short]), strict=True)})
        get = self.pieces.__getitem__
        segments.put({x: b"".join(map(get, ps)) for x, ps in parts.items()})

    def settled(self, text: str) -> Iterator[bytes]:
        """Ids of whole pieces, as little-endian 32-bit bytes."""
        if NEAR_SPACE.search(text):
            yield b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
            return
        head, *tail = text.split(" ")
        yield b"".join(map(self.pieces.__getitem__, self.pattern.findall(head)))
        yield b"".join(map(self.segments.__getitem__, tail))

    def encode(self, text: str) -> Iterator[bytes]:
        """Runs of ids as little-endian 32-bit bytes."""
        at = 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            yield from self._part(text, at, m.start())
            yield np.array([self.special[m.group()]], dtype="<u4").tobytes()
            at = m.end()
        yield from self._part(text, at, len(text))

    def _part(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        stream = Stream(self)
        for at in range(start, stop, SLICE):
            yield from stream.feed(text[at : min(stop, at + SLICE)], last=at + SLICE >= stop)

    def decode(self, runs: Iterable[bytes]) -> Iterator[str]:
        """Text of runs of ids, a bounded number of tokens at once; takes a run only when it is asked for more."""
        machine, get = codecs.getincrementaldecoder("utf-8")("replace"), self.table.__getitem__
        for run in runs:
            ids = np.frombuffer(run, dtype="<u4")
            for at in range(0, len(ids), DECODE_AT_ONCE):
                yield machine.decode(b"".join(map(get, ids[at : at + DECODE_AT_ONCE].tolist())))
        yield machine.decode(b"", final=True)

    def round_trip(self, text: str, keep: list | None = None) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids and of the decoded text, taken while they stream by. keep gets the ids."""
        ids, out, n = hashlib.sha256(), hashlib.sha256(), 0

        def seen():
            nonlocal n
            for run in self.encode(text):
                ids.update(run)
                n += len(run) // 4
                if keep is not None:
                    keep.append(run)
                yield run

        for piece in self.decode(seen()):
            out.update(piece.encode())
        return n, ids.hexdigest(), out.hexdigest()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_vocabulary(spark, path: str | None = None):
    """The vocabulary file's bytes, broadcast: a fixed file of 1.6 MB, refused beyond 64 MB."""
    with open(path or vocabulary_path(), "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"a vocabulary file of {len(data)} bytes is too large to broadcast")
    return Published(spark, data)


def _round_trip(vocabulary, schema: pa.Schema, emit_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.made("bpe", Codec)
        for batch in batches:
            counts, id_hashes, text_hashes, ids = [], [], [], []
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            codec.prime([t for t in texts if t])
            for text in texts:
                runs = [] if emit_ids else None
                for column, value in zip((counts, id_hashes, text_hashes), codec.round_trip(text or "", runs), strict=True):
                    column.append(value)
                if emit_ids:
                    ids.append(np.frombuffer(b"".join(runs), dtype="<u4").astype(np.int32))
            own = [pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(text_hashes)]
            if emit_ids:
                own.append(pa.array(ids, pa.list_(pa.int32())))
            kept = [batch.column(k) for k in range(batch.num_columns) if emit_ids or batch.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays(kept + own, schema)

    return run


OWN = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each whole text (null: empty) and decode it again.

    Adds n_tokens, ids_sha256 and decoded_sha256, with_ids also the ids and all other columns;
    otherwise only doc_id is carried. Columns of those names are replaced. Rows repeat as they
    come, an empty table gives an empty one.
    """
    from pyspark.sql import types as T

    spark = docs.sparkSession
    prepare(spark)
    own = T._parse_datatype_string(OWN + (", ids array<int>" if with_ids else ""))
    taken = {f.name.lower() for f in own}
    if with_ids:
        docs = docs.select(*columns_of(docs, [c for c in docs.columns if c.lower() not in taken]))
    else:
        docs = docs.select("doc_id", "text")
    schema = T.StructType([f for f in docs.schema if with_ids or f.name != "text"] + own.fields)
    names = [f.name for f in schema]
    run = _round_trip(load_vocabulary(spark, path), names, with_ids)
    return docs.mapInArrow(run, schema)


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their token ids, counts and digests.

    Columns called n_tokens, ids, ids_sha256 or decoded_sha256 are replaced. Null texts are encoded
    as empty ones and stay null; repeated rows repeat; an empty table gives an empty one.
    """
    return encode_decode(docs, with_ids=True)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"))
