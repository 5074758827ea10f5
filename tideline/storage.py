"""Durable intermediate tables.

Lineage is cut by writing parquet below the folder that the session names in
``spark.checkpoint.dir``; every executor and the driver can read it, so a lost
executor costs a re-read and never a result.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_recording: list[list[str]] = []
_then: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a folder of our own where it is unset and the master is local (tests, notebooks).

    On a cluster a machine's own folder would hold only what that machine wrote, so there it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='tideline-')}"
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    for made in _recording:
        made.append(path)
    atexit.register(remove, spark, path)
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths that are made inside."""
    made: list[str] = []
    _recording.append(made)
    try:
        yield made
    finally:
        _recording[:] = [x for x in _recording if x is not made]


def on_remove(path: str, then: Callable[[], None]) -> None:
    """What else is to go when a scratch path is removed."""
    _then[path] = then


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch paths made inside at the end, for callers that have written their result by then."""
    with recorded() as made:
        try:
            yield
        finally:
            for path in made:
                remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API; a stopped session leaves nothing to do."""
    _then.pop(path, lambda: None)()
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway is gone at interpreter exit
        return


def bytes_read(df: DataFrame) -> int:
    """The sizes of the tables that df reads, added up; the estimate of a join would be the product of its sides. Tables of unknown size do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def spread(df: DataFrame, each: int = 64 << 20, most: int = 1 << 16) -> int:
    """Partitions for a shuffle of df: spark.sql.shuffle.partitions, or more where the tables that it reads have more parts of ``each`` bytes."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-bytes_read(df) // each)))


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = (), into: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so what follows never recomputes it.

    ``by`` writes one folder per value, for readers that filter on it.
    """
    spark = df.sparkSession
    path = into or scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema if by else df.schema).parquet(path)
