"""What the operators share: tables, shared storage and column checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

DEFAULT_TOKENIZER = "piece_bpe_32k.model"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. A session that has Spark's default for Arrow batches gets smaller ones: rows are long, and both sides hold a batch at once."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and survives the loss of executors."""
    # small row groups: a task holds one in memory while it writes
    return storage.written(df, **{"parquet.block.size": str(1 << 25)})


#: Tables of so many bytes or fewer may go to every executor.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame) -> DataFrame:
    """``df`` written once, and marked for broadcast only if its measured bytes are few; else joins shuffle."""
    df = written(df)
    sizes = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 64 * F.size(c)}
    row = F.lit(16)
    for f in df.schema.fields:
        row = row + F.coalesce(sizes.get(f.dataType.typeName(), lambda c: F.lit(16))(F.col(f"`{f.name}`")), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def other_names(have: Iterable[str], new: Iterable[str]) -> list[str]:
    """``have`` without the names of ``new`` columns, whatever their case: a new column takes the place of an old one."""
    taken = {c.lower() for c in new}
    return [c for c in have if c.lower() not in taken]


def in_batches(batches: Iterator[pa.RecordBatch], text: str, docs: int, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows with their texts, in groups of ``docs`` rows at most that end once they have ``chars`` characters."""
    for batch in batches:
        at, texts, size = 0, [], 0
        for value in batch.column(text):
            texts.append(value.as_py())
            size += len(texts[-1] or "")
            if size >= chars or len(texts) >= docs:
                yield batch.slice(at, len(texts)), texts
                at, texts, size = at + len(texts), [], 0
        if texts:
            yield batch.slice(at), texts


def released() -> None:
    """Gives memory that a finished task of a worker no longer uses back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
