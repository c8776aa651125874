"""Submissions as a stream: each micro-batch is one ingest over the latest snapshot of leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest
from ..schemas import SUBMISSION
from ..sources.leads import write_table
from ..storage import cleared, mark

#: When a submission's file came in, and which one it is.
ARRIVAL = ("__arrived", "__file")


def stream_submissions(spark: SparkSession, path: str) -> DataFrame:
    """JSON files as they come in below ``path``, with the arrival of their file."""
    rows = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", 64).json(path)
    return rows.select(*SUBMISSION.names, F.col("_metadata.file_modification_time").alias(ARRIVAL[0]), F.col("_metadata.file_path").alias(ARRIVAL[1]))


def in_order(batch: DataFrame) -> DataFrame:
    """``batch`` with pos: by arrival of the file, then its path, then the place in it. Positions have gaps; the sort is spread over ranges."""
    placed = batch.withColumn("__place", F.monotonically_increasing_id())
    return placed.orderBy(*[c for c in ARRIVAL if c in batch.columns], "__place").withColumn("pos", F.monotonically_increasing_id()).drop("__place", *ARRIVAL)


def start(subs: DataFrame, leads_path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """Writes a snapshot of leads for every batch: ``leads_path``/batch=n; the first is read from batch=-1.

    A batch that is run again after a failure reads the snapshot before it and
    replaces its own outputs, so nothing counts twice. Tables that a batch
    makes on its way are deleted when it is done.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        since = mark(spark)
        leads = spark.read.parquet(f"{leads_path}/batch={number - 1}")
        out = ingest(in_order(batch), leads, F.current_timestamp())
        write_table(out.leads, f"{leads_path}/batch={number}")
        write_table(out.log, f"{log_path}/batch={number}")
        cleared(spark, since)

    return subs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
