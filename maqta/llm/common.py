"""Helpers that the corpus operators share: storage, Arrow text access, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


#: Rows that a Python worker is sent at once: texts and sets are long.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is set only where the session names none and runs in one process, as in tests; on a
    cluster a session without one is an error, since its machines would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="maqta-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run meanwhile sends Python workers ``rows`` rows at once at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing.

    rows: how many a Python worker is sent at once, fewer where a row may be long.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches_of(spark, rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._maqta_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    for df in tables:
        path = getattr(df, "_maqta_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def salted(rows: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 8, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small`` (a row per ``key``) on ``key``, each key's rows dealt out to ``salts`` tasks by ``spread``.

    Null keys match nothing.  ``small`` is repeated ``salts`` times, so no key, however hot, lands in one task.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Gives memory that this Python worker no longer needs back to the system; idle workers stay alive beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """A function for mapInArrow that releases memory when its partition is done."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array in one array, and each row's offsets in it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n, o = len(column), column.offset
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[o : o + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``most`` bytes of text each (a longer single row stands alone)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    start = np.uint64(seed * int(MIX2) % (1 << 64))
    return mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN + start)


#: Places in a word that have a table of random numbers; places beyond are scrambled one by one.
_PLACES = 64


def place_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte at each of the first places of a word."""
    return np.concatenate([byte_table(seed + 1000 * (i + 1)) for i in range(_PLACES)])


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, which do not overlap and come in order, by content alone.

    Each byte gives a random number that depends on it and on its place in the span; sums of them have none of
    the structure by which polynomials modulo a power of two collide.  ``values`` is a ``place_table``.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    small = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.arange(first[-1], dtype=small)
    place -= np.repeat(first[:-1].astype(small), size)
    byte = data[place + np.repeat(start.astype(small), size)]
    at = np.minimum(place, _PLACES - 1)
    at *= 256
    at += byte
    part = values[at]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        part[far] = mix64(values[byte[far]] ^ (place[far].astype(np.uint64) * GOLDEN))
    return mix64(np.add.reduceat(part, first[:-1]) + size.astype(np.uint64) * MIX1)


# Hashes of any spans of a text: polynomials modulo the prime 2**61 - 1.

PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x0B5297A4D3F8C6E1 % ((1 << 61) - 1)
#: Bytes of one text that prefix sums can take in.
SPAN_BYTES = 1 << 21
_TABLES: list[np.ndarray] = []


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def multiply61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    mid = (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half)
    return _reduce(_reduce(np.uint64(2) * a1 * b1 + mid) + _reduce(a0 * b0))


def _powers61(n: int) -> list[np.ndarray]:
    """base**i and base**-i for i <= n."""
    if not _TABLES or len(_TABLES[0]) <= n:
        size = 1 << max(16, n.bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, int(PRIME))):
            p, step = np.ones(1, np.uint64), base
            while len(p) < size:
                p = np.concatenate([p, multiply61(p, np.uint64(step))])
                step = step * step % int(PRIME)
            made.append(p)
        _TABLES[:] = made
    return _TABLES


class Spans:
    """Hashes of spans of a text of ``SPAN_BYTES`` at most: equal for equal spans, wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        if len(data) > SPAN_BYTES:
            raise ValueError(f"a text of {len(data)} bytes must be hashed in parts")
        p, wide = _powers61(len(data))[0][: len(data)], data.astype(np.uint64) + np.uint64(1)
        # Sums of products of a byte with either half of a power do not overflow.
        self.sums = np.zeros((2, len(data) + 1), np.uint64)
        np.cumsum(wide * (p & np.uint64((1 << 32) - 1)), out=self.sums[0, 1:])
        np.cumsum(wide * (p >> np.uint64(32)), out=self.sums[1, 1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = self.sums[0, end] - self.sums[0, start], self.sums[1, end] - self.sums[1, start]
        total = _reduce(_reduce(low) + multiply61(_reduce(high), np.uint64(1 << 32)))
        return multiply61(total, _powers61(self.sums.shape[1])[1][start])


def roll64(values: np.ndarray, width: int) -> np.ndarray:
    """Quick 64-bit numbers of all spans of ``width`` values, good enough to deal spans out by: never to take two for equal."""
    base = int(GOLDEN)
    out, step, done = values.copy(), base, 1
    total, held = np.zeros(len(values), np.uint64), 0
    while True:  # spans of powers of two, put together to ``width``
        if width & done:
            n = len(values) - held - done + 1
            total[:n] = total[:n] * np.uint64(step) + out[held : held + n]
            held += done
        if 2 * done > width:
            return mix64(total[: len(values) - width + 1])
        out[: len(out) - done] = out[: len(out) - done] * np.uint64(step) + out[done:]
        out = out[: len(out) - done]
        step, done = step * step % (1 << 64), 2 * done
