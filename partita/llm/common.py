"""Shared helpers: the shared folder, written tables, text slices and hashed words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one on a local master, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="partita-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/partita/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: A setting of Spark (4.1 on): the shuffle files of a query go when it has ended, not when the driver's memory is next cleared.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df written once as Parquet in the shared folder and reread: cuts lineage, survives lost executors.

    The shuffle files of the write are deleted when it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, each: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with each (one row per key, its number of rows in column n, dropped here), hot keys without a shuffle.

    Keys above total / (4 x shuffle partitions) rows number at most 4 x shuffle partitions, so they are broadcast; all
    others are joined by a shuffle, where none fills a task. how: inner or left (null keys find nothing).
    """
    cut = max(total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    hot = F.broadcast(each.filter(F.col("n") > cut).drop("n"))
    warm = rows.join(hot, on)
    cold = rows.join(hot.select(*on), on, "left_anti").join(each.filter(F.col("n") <= cut).drop("n"), on, how)
    return warm.unionByName(cold)


@contextlib.contextmanager
def memory_kept():
    """Within a task freed memory stays with the worker for its next arrays (asking for fresh pages costs more than the sums on them); then it goes back.

    Workers are kept between tasks and stages; what they have freed but not returned would count against the executor while
    other stages, or the JVM, need it.
    """
    library = ctypes.CDLL(None)
    if there := hasattr(library, "mallopt") and hasattr(library, "malloc_trim"):  # the GNU C library
        library.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: larger arrays have pages of their own
        library.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if there:
            library.malloc_trim(0)


def lean(run):
    """A function for mapInPandas whose worker keeps its memory for the time of a task (see memory_kept)."""

    def task(batches):
        with memory_kept():
            yield from run(batches)

    return task


def whole_groups(batches, keys: list[str]):
    """Frames of whole groups from batches that are sorted by keys; what is held back is one group and one batch at most."""
    held = None
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        same = np.ones(len(b), dtype=bool)
        for k in keys:
            v = b[k].to_numpy()
            same &= v == v[-1]
        first = len(b) - int(same[::-1].argmin()) if not same.all() else 0
        if first:
            yield b.iloc[:first].reset_index(drop=True)
        held = b.iloc[first:].reset_index(drop=True)
    if held is not None:
        yield held


def group_numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """0, 1, ... by group of a frame that is sorted by keys."""
    new = np.zeros(len(frame), dtype=bool)
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def pairs_by_offset(group: np.ndarray):
    """(i, j) arrays of all index pairs within groups (numbers in ascending order), nearest neighbours first.

    A generator: the pairs of one offset at a time, so memory stays at one number a row.
    """
    at, d = np.arange(len(group)), 1
    while True:
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return
        yield at, at + d
        d += 1


def slices(text: str, size: int = 1_000_000):
    """Consecutive parts of text of about `size` characters, cut only after a space or line end."""
    at, n = 0, len(text)
    while n - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut < at:  # one very long word: go on to its end
            ends = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
            cut = min(ends, default=n - 1)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: For each byte, its eight bits in the eight lanes of a 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each segment have each of the 64 bits set. Segments are not empty and start at `starts`."""
    lengths = np.diff(np.append(starts, len(hashes)))
    parts = -(-lengths // 255)  # lanes are bytes: at most 255 rows are added before they are widened
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    at = np.repeat(starts, parts) + 255 * within
    octets = np.ascontiguousarray(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(starts), 64), dtype=np.int64)
    for b in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, b]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, 8 * b : 8 * b + 8] = np.add.reduceat(lanes, first, axis=0)
    return counts


def fingerprints(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is 1 if over half of a segment's hashes have it."""
    on = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view(np.int64).ravel()
