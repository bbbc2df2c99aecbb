"""Sessions for tests, benches and scripts; on a cluster the caller brings its own."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def local_session(app: str = "hardwood", cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local[cpus] session in UTC, with few shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may go without, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.hardwood.shared", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="hardwood-")
    spark.conf.set("spark.hardwood.shared", base)
    return base


_scopes: list[list[tuple[SparkSession, str]]] = []


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for what one run writes. It belongs to the run's lazy result, and goes at the
    end of a `run_scope`, once that has been written."""
    path = f"{shared_folder(spark)}/hardwood/{name}-{uuid.uuid4().hex}"
    for made in _scopes[-1:]:
        made.append((spark, path))
    return path


@contextlib.contextmanager
def run_scope() -> Iterator[None]:
    """Removes the folders of every run that was begun inside; write their results before it ends."""
    made: list[tuple[SparkSession, str]] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for spark, path in made:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
