"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its initial symbols less the merges made; no identifier
is looked up or emitted (see ``pieces.PieceModel.count``). Words that were
seen come from a cache of bounded size; as it holds small numbers only, it
keeps more words than that of an encoder.

Cases: a null text counts as empty (0 bytes, 0 tokens); texts are counted
whole; repeated rows stay; an empty table gives an empty result; the columns
of the input are kept, but a new column takes the place of one with its name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, other_names, released, table, tokenizer_path
from .pieces import Cache, PieceModel, load

#: Words kept by a worker: some 80 MB at most.
COUNT_WORDS = 450_000


class Counter:
    def __init__(self, model: PieceModel):
        self.model = model
        self.cache = Cache(model.count, COUNT_WORDS)

    def text(self, text: str | None) -> int:
        return sum(map(self.cache.__getitem__, self.model.words(self.model.normalized(text or ""))))


@functools.lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    return Counter(load(path))


def count_tokens(df: DataFrame, text: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """``df`` without the text, with n_bytes long (UTF-8), n_tokens long and over_limit boolean."""
    path = model or tokenizer_path()
    names = other_names([c for c in df.columns if c != text], ("n_bytes", "n_tokens", "over_limit"))
    plain = df.select(
        *[F.col(f"`{c}`") for c in names], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("__text")
    )
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for part, texts in in_batches(batches, "__text", 1024, 4_000_000):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(counter.text, texts), pa.int64())], names=[*part.schema.names[:-1], "n_tokens"])
        released()

    return plain.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
