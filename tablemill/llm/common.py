"""What the operators share: session settings, written intermediate tables, word hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.plans.scratch import folder

#: Rows of an Arrow batch for Python. Texts can be long, so batches hold few rows.
BATCH_ROWS = 256
#: Entries of each of the two generations of a worker's memo.
MEMO_WORDS = 120_000


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage.

    Lost executors cost nothing that was written. drop() removes the files of a table that
    nothing needs any more.
    """
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tablemill_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def drop(df: DataFrame) -> None:
    """Remove what written() wrote for df, if that is still there."""
    spark, path = df.sparkSession, getattr(df, "_tablemill_path", None)
    if path:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


_OPEN: list[list[DataFrame]] = []


def tidied(make):
    """make, with its result written and the tables that it wrote on the way removed."""

    @wraps(make)
    def run(*args, **kwargs):
        _OPEN.append([])
        try:
            out = written(make(*args, **kwargs))
        finally:
            tables = _OPEN.pop()
        for table in tables:
            if table is not out:
                drop(table)
        if _OPEN:
            _OPEN[-1].append(out)
        return out

    return run


def columns_of(df: DataFrame, names: list[str] | None = None) -> list:
    """df's columns, or some of them, whatever characters their names hold."""
    return [df["`" + c.replace("`", "``") + "`"] for c in (df.columns if names is None else names)]


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Words of 64 flags in a sieve: what is broadcast has this bound, whatever the tables hold.
SIEVE_WORDS = 1 << 17


def sifted(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose `column` may be in ids, rows that surely aren't in it), both with df's columns.

    ids has one column of longs. Its hashes set flags in a table of SIEVE_WORDS words, which is all
    that is broadcast; an exact join has to follow for the first part, whose share of df grows with
    ids. Rows with a null belong to the second part. The text columns of the second part are never shuffled.
    """
    word, bits = fresh(df, "_sieve_word"), fresh(df, "_sieve_bits")
    spot = f"(xxhash64({{0}}) >>> 6) & {SIEVE_WORDS - 1}L"
    flag = "cast(xxhash64({0}) & 63L as int)"
    ids = ids.toDF("_sieve_id_").filter("_sieve_id_ is not null")
    sieve = ids.select(F.expr(spot.format("_sieve_id_")).alias(word), F.expr(f"shiftleft(1L, {flag.format('_sieve_id_')})").alias("_sieve_bit_")).groupBy(word).agg(F.bit_or("_sieve_bit_").alias(bits))
    key = f"cast(`{column}` as bigint)"
    marked = df.join(F.broadcast(sieve), F.expr(spot.format(key)) == F.col(word), "left")
    hit = F.expr(f"`{column}` is not null and {bits} is not null and (shiftright({bits}, {flag.format(key)}) & 1L) = 1L")
    return marked.filter(hit).select(*columns_of(df)), marked.filter(~hit).select(*columns_of(df))


class Memo(dict):
    """Results by key in two generations: frequent keys outlive the rare ones, and both are bounded."""

    def __init__(self, size: int = MEMO_WORDS):
        self.size, self.old = size, {}

    def make(self, key):
        raise NotImplementedError

    def put(self, values: dict) -> None:
        """Add several results at once; a generation may pass its size by them."""
        if len(self) + len(values) > self.size:
            self.old = dict(self)
            self.clear()
        self.update(values)

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordHashes(Memo):
    """64-bit hash of a word's bytes."""

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def byte_texts(column: pa.Array) -> list:
    """A string column's values as UTF-8 bytes, None for null."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs outside \\x20 and \\x09-\\x0D, with A-Z lowered."""
    return text.lower().split()


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def _coefficients(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}/{k}".encode()) | 1 for k in range(n)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer over 64 bits (the constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SHINGLE = 5
_SHINGLE_BY = _coefficients(64, 11)


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all word shingles, in order; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out += h[k : k + n] * _SHINGLE_BY[k]
    return mixed(out)


class MinHasher:
    """MinHash signatures of hashed sets: `bands` bands of `rows` 32-bit minima."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        k = bands * rows
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
        self.plus = rng.integers(0, 2**32, k, dtype=np.uint32)
        self.band_by = _coefficients(rows, 13)

    def signature(self, elements: np.ndarray) -> np.ndarray:
        """Minima of (x ^ plus) * times over 32 mixed bits of the elements."""
        low = (elements >> np.uint64(32)).astype(np.uint32)
        sig = np.full(len(self.times), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), 128):
            block = (low[at : at + 128, None] ^ self.plus) * self.times
            np.minimum(sig, block.min(axis=0), out=sig)
        return sig

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; bands have keys of their own."""
        parts = sig.reshape(self.bands, self.rows).astype(np.uint64)
        total = (parts * self.band_by).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)
        return mixed(total)


def given_back() -> None:
    """Return what this process has freed to the system; Arrow and the C library keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_SHARED: dict = {}
_GROUP: list = [None]


def shared(group: str, key, make):
    """make() once per Python worker, operator group and key. A worker holds one group's objects only,
    so what one stage keeps doesn't burden the next one's memory."""
    if _GROUP[0] != group:
        _SHARED.clear()
        given_back()
        _GROUP[0] = group
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


class Published:
    """A broadcast value of bounded size, with a name under which workers keep what they make of it."""

    def __init__(self, spark: SparkSession, value):
        self.name = uuid.uuid4().hex
        self.broadcast = spark.sparkContext.broadcast(value)

    def made(self, group: str, make):
        """make(value), once per Python worker while it works for this group; an older one of the kind goes."""
        kind = f"{make.__module__}.{make.__qualname__}"
        if _GROUP[0] == group:
            for old in [k for k in _SHARED if k[0] == kind and k[1] != self.name]:
                del _SHARED[old]
        return shared(group, (kind, self.name), lambda: make(self.broadcast.value))
