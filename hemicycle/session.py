"""Session helpers: a default session and reliable materialisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "hemicycle", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; settings given by the caller's environment win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by the hash of ``keys`` over as many tasks as there are cores, where they are fewer: a small file is one task otherwise, however long its texts take. Large inputs have more tasks and stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary folder only where the setting is absent, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = jvm_dir.get() if jvm_dir.isDefined() else None
    if not shared:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="hemicycle-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def numbered(spark: SparkSession, path: str) -> list[int]:
    """The folders in a folder whose names are numbers and that were written to the end, in order; none if it is not there."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return []
    return sorted(int(x.getPath().getName()) for x in files.listStatus(target) if x.getPath().getName().isdigit() and _is_whole(spark, x.getPath().toString()))


def _is_whole(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(target)


_written: list[tuple[SparkSession, str]] = []


def _remove_since(first: int) -> None:
    while len(_written) > first:
        spark, path = _written.pop()
        try:
            removed(spark, path)
        except Exception:  # the session has ended; the folder is left to its owner
            pass


atexit.register(_remove_since, 0)


@contextmanager
def released() -> Iterator[None]:
    """Removes at its end the tables that were materialised in it; results that read them must have been written by then."""
    first = len(_written)
    try:
        yield
    finally:
        _remove_since(first)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that an expensive input is computed once though several branches of a plan
    use it, and survives the loss of executors. The table is removed at the end of the ``released``
    block around it, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/materialised/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
