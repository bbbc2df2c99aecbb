"""What the corpus operators share: tables, scratch tables in the shared folder, fixed word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class, and the same characters as text.
SPACES_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACES_CLASS + "+"), "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may go without, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.hardwood.scratch", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="hardwood-")
    spark.conf.set("spark.hardwood.scratch", base)
    return base


#: Shuffle partitions that a task of a packed table takes at most, and tasks a core that there are at least.
PACK, WAVES = 8, 4
#: No .crc files beside Parquet's own checksums, where the shared folder is a local one.
NO_CRC = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def packed(df: DataFrame) -> DataFrame:
    """df in fewer partitions, without a shuffle. Each of them becomes a file, and for each file and each .crc file in a
    local folder Hadoop forks the executor's JVM to set permissions, whose memory counts twice for an instant."""
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(WAVES * spark.sparkContext.defaultParallelism, -(-shuffled // PACK)))


class Scratch:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A written table cuts the lineage and outlives lost executors. Tables go when `drop` is called; what is left
    belongs to the lazy result and goes with `clear`, or at the end of a `scratch_scope`, once that has been written.
    With `pack`, tables are written in few files."""

    def __init__(self, spark: SparkSession, name: str, pack: bool = False):
        self.spark, self.root, self.pack = spark, f"{shared_dir(spark)}/hardwood/{name}-{uuid.uuid4().hex}", pack
        self._n = 0
        for made in _scopes[-1:]:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, as_dealt: bool = False) -> DataFrame:
        """Writes df and reads it back. as_dealt: is not packed, as its rows are named by their partitions or its tasks
        are few and long."""
        self._n += 1
        path = self.path(f"{name}-{self._n}")
        few = packed(df) if self.pack and not as_dealt else df
        few.write.options(compression="zstd", **(NO_CRC if self.pack else {})).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._hardwood_path = path
        return kept

    def _delete(self, uri: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            self._delete(df._hardwood_path)

    def release(self) -> None:
        """Lets go of what finished steps hold on the driver: plans, which Python's handles keep alive in the JVM, and
        broadcasts and shuffles, which Spark cleans up once these are collected."""
        gc.collect()
        self.spark._jvm.java.lang.System.gc()

    def clear(self) -> None:
        """Removes all that this run has written."""
        self._delete(self.root)


_scopes: list[list[Scratch]] = []


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Clears the scratch tables of every operator that was called inside; write their results before it ends."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for scratch in made:
            scratch.clear()


def give_back() -> None:
    """Returns freed memory to the system; allocators keep much of it for later, and an executor's idle workers add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def thrifty(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step, for mapInArrow, with the worker's freed memory given back after each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; every partition counts its own."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a count; larger sides are joined by a shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df
