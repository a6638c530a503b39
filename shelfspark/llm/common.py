"""What the operators of this subpackage share: registry, scratch tables, byte-level text arrays.

Texts reach the operators as Arrow string columns.  ``text_bytes`` exposes such a column as one
byte array with offsets, without making Python strings; ``blocks`` cuts it into runs of whole
documents so that numpy temporaries stay within a few megabytes whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfspark.session import scratch, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

pa.set_memory_pool(pa.system_memory_pool())     # so that freed memory can be handed back, see release()

BATCH_ROWS = 1000       # rows and bytes of an Arrow batch: bound what a Python worker holds at once
BATCH_BYTES = 4 << 20
BLOCK_BYTES = 1 << 19   # bytes of text that numpy works on at once


def query(name: str, sql: str | None = None):
    """Register ``build(spark, folder)`` as a query, and its SQL where SQL can say it."""
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepared(spark), folder)
        run.__doc__, run.__name__ = build.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def in_part(remainder: int, modulus: int, column: str = "doc_id") -> Column:
    """True for rows of one fold: crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus == remainder


class Stored:
    """A table in the shared folder: written at once, read any number of times, dropped by hand
    when nothing reads it any more.  It cuts the lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, label: str, by: list[str] | None = None):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = scratch(self.spark, label)
        (df.write.partitionBy(*by) if by else df.write).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def join_by_key(df: DataFrame, per_key: DataFrame, keys: list[str], weight: str, hot: int = 256) -> DataFrame:
    """Inner join to a frame with one row per key, whose ``weight`` counts the rows of ``df`` with that
    key.  The heaviest ``hot`` keys, a fixed number of rows, are broadcast, so that their rows stay
    where they are; only the rest is shuffled.  Both frames should be stored tables, as each is read
    twice."""
    heavy = F.broadcast(per_key.orderBy(F.col(weight).desc(), *keys).limit(hot))
    rest = df.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(per_key, keys)
    return df.join(heavy, keys).unionByName(rest)


def one_per_id(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of rows that share an id one (the smallest in ``columns``), so that a bound on ids bounds rows."""
    return rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("_one")).select(key, "_one.*")


def release() -> None:
    """Hands freed memory back to the system: Python workers live on between stages, and several
    share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents of at most ``limit`` bytes, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept and lengthened on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        def row(base):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            return np.multiply.accumulate(out)
        _powers[:] = [row(_BASE), row(_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """The words of a block of documents as arrays: start, end, document and 64-bit hash.

    ``kind`` says by byte which bytes belong to words; upper-case ASCII is hashed as lower case.
    Words never cross documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        n = len(data)
        inside = kind[data]
        first, last = offsets[:-1], offsets[1:] - 1
        full = last >= first
        edge = np.zeros(n, bool)
        edge[first[full]] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge))
        edge[:] = False
        edge[last[full]] = True
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge)) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(LOWERED[data] * up[:n], out=total[1:])
        self._total, self._down = total, down
        self.hash = self.upto(self.end)
        self.at = np.searchsorted(self.start, offsets)        # first word of each document
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))

    def upto(self, end: np.ndarray) -> np.ndarray:
        """Hash of each word's bytes from its start to ``end``."""
        return mix64((self._total[end] - self._total[self.start]) * self._down[self.start])


def _lowered() -> np.ndarray:
    values = _BYTE_VALUES.copy()
    values[65:91] = values[97:123]
    return values


LOWERED = _lowered()


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values (len - n + 1 of them)."""
    factor, out, done, step, power = 0xD6E8FEB86659FD93, None, 0, hashes, 1
    width = 1
    while width <= n:
        if n & width:
            if out is None:
                out = step.copy()
            else:
                m = min(len(out), len(step) - done)
                out = out[:max(m, 0)] + step[done:done + max(m, 0)] * np.uint64(pow(factor, done, 1 << 64))
            done += width
        m = len(step) - width
        step = step[:max(m, 0)] + step[width:] * np.uint64(pow(factor, width, 1 << 64)) if m > 0 else step[:0]
        width *= 2
    return mix64(out[:max(len(hashes) - n + 1, 0)])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint ones, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], np.append(e[:-1][new[1:]], e[-1])


def append(df: DataFrame, fields: str, make, after=None) -> DataFrame:
    """``df`` with the columns of the DDL string ``fields``, which ``make`` (record batch -> list of
    Arrow arrays or Python lists) computes; columns of these names that ``df`` has are replaced.
    ``after`` is called at the end of a partition, to forget what the worker has remembered."""
    new = T.StructType.fromDDL(fields)
    kept = [name for name in df.columns if name not in new.names]
    schema = T.StructType([df.schema[name] for name in kept] + list(new.fields))
    arrow = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches):
        for batch in batches:
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, kind in zip(make(batch), arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in kept] + made, kept + new.names)
        if after:
            after()
        release()
    return df.mapInArrow(run, schema)
