"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written, in order, by application.
_made: dict[str, list[str]] = {}

#: Whether Spark deletes the shuffles of a job as soon as the job ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, one machine (tests) gets a temporary folder, once for
    the session; a cluster has no folder that would do, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="leadloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, without lineage; ``options`` are those of the writer. Shuffles that led to it are deleted at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leads-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    with _shuffles_deleted(spark):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leadloom_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables as ``written`` returned them; frames that read them must not be used any more."""
    for table in tables:
        spark, path = table.sparkSession, table._leadloom_path
        system, p = _path(spark, path)
        system.delete(p, True)
        made = _made.get(spark.sparkContext.applicationId, [])
        if path in made:
            made.remove(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return system.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When ``path`` was changed last, in milliseconds."""
    system, p = _path(spark, path)
    return system.getFileStatus(p).getModificationTime()


def mark(spark: SparkSession) -> int:
    """A point in time for ``cleared``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def cleared(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes what ``written`` has made since a ``mark``, but for the last ``keep`` tables; frames that read it must not be used any more. Returns how many tables."""
    made = _made.get(spark.sparkContext.applicationId, [])
    gone = made[since : len(made) - keep]
    for path in gone:
        system, p = _path(spark, path)
        system.delete(p, True)
    del made[since : len(made) - keep]
    return len(gone)
