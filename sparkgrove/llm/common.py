"""Helpers shared by the operators of this subpackage: shared-folder tables,
column hygiene and vectorised word splitting on Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the numpy stages of a Python worker.
SLICE_BYTES = 2 << 20
#: Rows that a Python worker is sent at once.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on Python workers of its session get at most BATCH_BYTES (or one row) at once."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def shielded(df: DataFrame):
    """df with columns that begin with __ under other names, so that an operator's own
    columns clash with none, and a function that picks and renames them back."""
    names, taken, inner = df.columns, {c.lower() for c in df.columns}, []
    for i, c in enumerate(names):
        name = c
        while name.startswith("__") or (name != c and name.lower() in taken):
            name = f"own{i}_{name.lstrip('_')}"
        inner.append(name)
    return df.toDF(*inner), lambda out: out.select(*(F.col(f"`{c}`") for c in inner)).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a local
    session, which has one machine, gets a temporary one where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="grove_shared_")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage
    is cut, and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grove/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._grove_path = path
    return out


def erased(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._grove_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    # Arrow's case kernels misread arrays whose first offset isn't 0, as slices have
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if offsets is not None and len(offsets) else np.zeros(1, np.int64)
    if at[0]:
        arr = pa.LargeStringArray.from_buffers(len(arr), pa.py_buffer(at - at[0]), data.slice(int(at[0])))
    return arr


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds at most limit bytes of text (one
    row at least). What a batch needed goes back to the system: workers live on, and
    memory that two of them merely keep counts against their executor."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, ends = 0, np.cumsum(sizes)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, sizes, ends
        returned()


@lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def returned() -> None:
    """Hands free memory back to the operating system, where its library can."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def joined_bytes(texts: pa.Array, separator: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, each followed by the separator, and the
    start of each (one more at the end)."""
    both = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(separator, pa.large_string()))
    _, offsets, data = both.buffers()
    at = np.frombuffer(offsets, np.int64)[both.offset : both.offset + len(both) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(both) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([False], mask, [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of bytes other than x20 and x09-x0D."""
    return runs(~_SPACE[data])


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in lower case (A-Z), and where each text's begin."""
    data, at = joined_bytes(texts, " ")
    low = lower_bytes(data)
    start, end = word_spans(low)
    flat = np.ascontiguousarray(low[~_SPACE[low]])
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(end - start)))
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(flat))
    return words, np.searchsorted(start, at)


def picked(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[index] for indices known to lie within, which are not checked first."""
    return values.take(index, mode="clip")


POWERS = 3 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    got = _powers[name]
    if len(got) < n:
        full = np.full(-(-n // 65_536) * 65_536, base, np.uint64)
        full[0] = 1
        np.multiply.accumulate(full, dtype=np.uint64, out=full)
        got = full
        if len(got) <= POWERS:  # tables for a very long text are not kept
            _powers[name] = got
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Polynomial hashes modulo 2^64 of any substring of data, after a non-linear
    recoding of bytes."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        code = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * salt))
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code[data] * _grown("up", _MULT, n), out=self.sums[1:])
        self.down = _grown("down", pow(_MULT, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        """The hashes of all substrings of one size, by start."""
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))
