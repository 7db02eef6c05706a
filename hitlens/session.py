"""Session settings and the shared work folder."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
TIME_ZONE_CONF = "spark.sql.session.timeZone"
SHUFFLE_CONF = "spark.sql.shuffle.partitions"
ARCHIVE = "hitlens-package.zip"


def use_utc(spark: SparkSession) -> None:
    """Log times are read, split into hours and printed in UTC."""
    spark.conf.set(TIME_ZONE_CONF, "UTC")


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get(TIME_ZONE_CONF)
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"set {TIME_ZONE_CONF} to UTC; it is {zone}")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="hitlens-"))
    return context.getCheckpointDir().rstrip("/")


_job: ContextVar[str] = ContextVar("job", default="")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never an existing one."""
    folder = f"{shared_folder(spark)}/hitlens/{spark.sparkContext.applicationId}{_job.get()}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary_work(spark: SparkSession) -> Iterator[None]:
    """Work paths given out inside the block (in this thread) are in one folder, deleted at the end."""
    job = f"/job-{uuid.uuid4().hex}"
    before = _job.set(job)
    try:
        yield
    finally:
        _job.reset(before)
        app = f"{shared_folder(spark)}/hitlens/{spark.sparkContext.applicationId}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{app}{job}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(folder, True)
        for parent in (folder.getParent(), folder.getParent().getParent()):
            # Only where nothing else is left in it.
            if files.exists(parent) and not files.listStatus(parent):
                files.delete(parent, False)


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, wherever the driver imported it from.

    Done once per context; the archive is a file that Spark itself distributes.
    """
    context = spark.sparkContext
    if ARCHIVE in context._python_includes:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="hitlens-code-")) / ARCHIVE
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint does, survives lost executors, and keeps
    column pruning and filter pushdown for whoever reads it.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_shuffles(
    spark: SparkSession,
    path: str,
    expansion: float = 1.0,
    partition_bytes: int = 128 * 1024**2,
    most: int = 4000,
) -> int:
    """Raise the number of shuffle partitions until one holds ``partition_bytes`` of the input.

    ``expansion`` is how much larger the rows are than their files. Adaptive
    execution merges partitions that turn out small, but it cannot split those of
    an aggregate, so the number has to follow the data. It is never lowered, and
    raised to ``most`` at most, because every mapper keeps a block per partition;
    beyond that partitions grow and spill. Extract day by day rather than more.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(pattern) or []
    size = sum(files.getContentSummary(entry.getPath()).getLength() for entry in found)
    needed = min(most, math.ceil(size * expansion / partition_bytes))
    if needed > int(spark.conf.get(SHUFFLE_CONF)):
        spark.conf.set(SHUFFLE_CONF, str(needed))
    return int(spark.conf.get(SHUFFLE_CONF))


MAX_BROADCAST_ROWS = 100_000


def size_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """``df`` for a join, and its number of rows (counted up to one past ``max_rows``).

    It gets a broadcast hint when a count shows at most ``max_rows`` (narrow)
    rows. Beyond that Spark joins by shuffle, with adaptive skew handling. ``df``
    should be stored, so that counting it costs next to nothing.
    """
    count = df.limit(max_rows + 1).count()
    return (F.broadcast(df) if count <= max_rows else df), count


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return size_checked(df, max_rows)[0]
