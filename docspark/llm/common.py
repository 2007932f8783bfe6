"""What the operators of this subpackage share: shared folders, and a tokenizer that works on whole Arrow batches.

The tokenizer reads the UTF-8 bytes of many texts as one numpy array. A byte of 128 or more is part of a word, so word
boundaries of code points and of bytes agree. A word's 64-bit hash is a polynomial over a fixed random value for each
byte, taken from prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.cluster import ship

#: Rows of an Arrow batch of texts, at most, while a stored table is made.
BATCH_ROWS = 2000
#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19
#: Bits of a bitmap of keys: so many for each key, at least, and at most. A full bitmap lets all rows through to the join.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    Where both are unset, a folder of our own if all runs on this machine (local master); on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not where and there.isDefined():
        where = there.get()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docspark-"))
        return shared_dir(spark)
    return where.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete what scratch() named, if it is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Tables:
    """Intermediate tables in the shared folder, which go when the context ends; those of result() stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def remove(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []

    def stored(self, df: DataFrame, what: str, batch: int | None = None) -> DataFrame:
        out, path = _stored(df, what, batch)
        self.paths.append(path)
        return out

    def result(self, df: DataFrame, what: str) -> DataFrame:
        return stored(df, what)


def in_bitmap(keys: DataFrame) -> tuple[DataFrame, Column, Column]:
    """A bitmap of a stored table's keys, for a broadcast; the part of it that a row's key is in, and whether its bit is on."""
    n = keys.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * n).bit_length()))
    place = lambda: F.pmod(F.xxhash64("key"), F.lit(size)) + 1
    rows = keys.select(place().alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bits_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    at = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1
    return F.broadcast(rows), F.bitmap_bucket_number(place()), on


def thinned(df: DataFrame, column: str, most: int, salt: int) -> DataFrame:
    """df, or if it has more than 2 * most rows, those with the smallest hashes of a column, about 2 * most of them.

    So what a later limit(most) gathers does not grow with df. Rows that repeat a value stay or go together.
    """
    total = df.count()
    if total <= 2 * most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * 2 * most / total))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, as no column of df is called (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch, list[bytes]], list]]) -> DataFrame:
    """df with columns computed from the texts of each Arrow batch.

    make() runs once per task and returns f(batch, texts) -> one list or array per field; a null text arrives as b"".
    All columns of df pass through as they are.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, at):
                new = f(part, texts_of(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, kind) for x, kind in zip(new, kinds, strict=True))], [*part.schema.names, *names])
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what a task has freed to the system: Spark keeps its Python workers, and they would keep that memory."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[bytes]:
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of batch with about CHUNK_BYTES of column `at` each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix64(h: np.ndarray) -> np.ndarray:
    """Murmur's finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _POWERS[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _POWERS[0], _POWERS[1]


def _byte_values(word: Callable[[int], bool], fold: bool) -> np.ndarray:
    values = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)
    for b in range(256):
        if fold and 65 <= b <= 90:
            values[b] = values[b + 32]
    for b in range(256):
        if not word(b):
            values[b] = 0
    return values


#: Words of ASCII letters (case aside), digits and all that is not ASCII.
ALNUM = _byte_values(lambda b: b >= 128 or chr(b).isalnum(), True)
#: Words of all but space and \\t \\n \\v \\f \\r, as they are.
SPACED = _byte_values(lambda b: b != 32 and not 9 <= b <= 13, False)


@dataclass
class Words:
    """The words of some texts: where each starts and ends in buf, its hash, and each text's range of words."""

    buf: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per text and one more: index of its first word
    sums: np.ndarray  # of byte values times powers, up to each byte

    def prefix_hash(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of `size` bytes or more, and the hash of the first `size` bytes of each."""
        long = np.flatnonzero(self.end - self.start >= size)
        start = self.start[long]
        return long, mix64((self.sums[start + (size - 1)] - self.sums[start - 1]) * powers(len(self.buf) + 1)[1][start] + np.uint64(size))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].lower()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and text of each run of n words of one text."""
        many = np.maximum(self.counts - n + 1, 0)
        text = np.repeat(np.arange(len(many)), many)
        return np.arange(len(text)) + np.repeat(self.first[:-1] - (np.cumsum(many) - many), many), text

    def window_hash(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += self.hash[at + k]
        return mix64(h)


def words_of(texts: list[bytes], values: np.ndarray = ALNUM) -> Words:
    buf = b" ".join([b"", *texts, b""])
    raw = np.frombuffer(buf, dtype=np.uint8)
    value = values[raw]
    inside = (value != 0).view(np.int8)
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
    up, down = powers(len(raw) + 1)
    value *= up[: len(raw)]
    total = np.cumsum(value, dtype=np.uint64)
    h = mix64((total[end - 1] - total[start - 1]) * down[start])
    offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Words(buf, start, end, h, np.searchsorted(start, offsets), total)


def stored(df: DataFrame, what: str, batch: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and its size is known to the planner.

    batch: rows of an Arrow batch while it is made, where rows are large.
    """
    return _stored(df, what, batch)[0]


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, Arrow batches have no more rows than this."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, min(int(before), rows) if int(before) > 0 else rows)
        yield
    finally:
        spark.conf.set(key, before)


def _stored(df: DataFrame, what: str, batch: int | None = None) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession, what)
    with batches_of(df.sparkSession, batch or BATCH_ROWS):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
