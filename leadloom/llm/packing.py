"""Token ids packed into rows of fixed length, as binary output.

Documents are tokenised whole. A document longer than a row is split without
loss: full rows first, then its rest. What is shorter than a row is packed by
best-fit decreasing: pieces in descending length go to the open row with the
least room that suffices, which a segment tree over the amounts of room finds
in O(log row length).

Documents are dealt to buckets by a hash of id and text and sorted by it, and
packed in groups of at most ``group_docs`` documents or ``GROUP_TOKENS`` tokens
of that order. So the rows depend on the documents alone, not on the files or
tasks they come from, and memory is bounded. A group leaves about half a row
unused at most in practice.

Each row of the result is one row of the matrix: ``ids`` (little-endian
32-bit, padded with ``pad_id``), ``cu_seqlens`` (cumulative lengths of its
segments, from 0), ``positions`` (where positions restart, i.e. the start of
every segment), and for each segment the document and its offset in it, so
that every document can be put together again.

Cases: a null or empty text has no tokens and no segment; very long texts span
many rows; repeated rows are packed each; a null doc_id is kept; an empty table
gives an empty result; unnamed columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table, tokenizer_path

ROW, GROUP_DOCS, GROUP_TOKENS = 2048, 4096, 4_000_000
#: Documents in a bucket, on average.
BUCKET_DOCS = 16_384


@functools.lru_cache(maxsize=1)
def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Rooms:
    """Open rows by room, with a segment tree that finds the least room that suffices."""

    def __init__(self, row: int):
        self.width = 1 << (row + 1).bit_length()
        self.tree = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(row + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, row: int, room: int) -> None:
        self.open[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, and its room."""
        tree, at = self.tree, need + self.width
        if not tree[at]:
            # up to the first right neighbour that holds a row, then down to its left-most leaf
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.width
        row = self.open[room].pop()
        self._add(room, -1)
        return row, room


def pack(lengths: list[int], row: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, offset, length): best fit, longest first, full rows of overlong documents by themselves."""
    rows: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        for at in range(0, n - n % row, row):
            rows.append([(d, at, row)])
        if n % row:
            rest.append((n % row, d, n - n % row))
    rooms = Rooms(row)
    for n, d, at in sorted(rest, key=lambda x: (-x[0], x[1])):
        found = rooms.take(n)
        if found is None:
            rows.append([])
            found = len(rows) - 1, row
        k, room = found
        rows[k].append((d, at, n))
        if room > n:
            rooms.put(k, room - n)
    return rows


_COLUMNS = ("ids", "n_ids", "cu_seqlens", "positions", "doc_ids", "offsets")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: int = ROW, group_docs: int = GROUP_DOCS, pad_id: int = 50256, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """ids binary, n_ids int, cu_seqlens, positions array<int>, doc_ids array, offsets array<bigint>: one row of the packed matrix each."""
    from pyspark.sql.pandas.types import to_arrow_type

    path = tokenizer_path(vocabulary)
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["id"].dataType
    n_buckets = max(1, -(-plain.count() // BUCKET_DOCS))
    key = F.xxhash64("id", "text")
    plain = plain.filter("text <> ''").select("id", "text", key.alias("key"), F.pmod(key, F.lit(n_buckets)).alias("bucket"))
    # as many partitions as buckets, so that what a task reads does not grow with the input
    plain = plain.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "key", "id", "text")
    id_arrow = to_arrow_type(kind)

    def group(ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in _COLUMNS]
        for segments in pack([len(t) for t in tokens], row):
            line = np.full(row, pad_id, dtype="<i4")
            ends = [0]
            for d, at, n in segments:
                line[ends[-1] : ends[-1] + n] = tokens[d][at : at + n]
                ends.append(ends[-1] + n)
            for column, value in zip(out, (line.tobytes(), ends[-1], ends, ends[:-1], [ids[d] for d, _, _ in segments], [at for _, at, _ in segments])):
                column.append(value)
        kinds = (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(id_arrow), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=list(_COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        ids, tokens, total, bucket = [], [], 0, None
        for batch in batches:
            for d, t, b in zip(batch.column("id"), batch.column("text"), batch.column("bucket").to_pylist()):
                if ids and (b != bucket or len(ids) >= group_docs or total >= GROUP_TOKENS):
                    yield group(ids, tokens)
                    ids, tokens, total = [], [], 0
                bucket = b
                ids.append(d.as_py())
                tokens.append(np.array(encode(t.as_py()), dtype="<i4"))
                total += len(tokens[-1])
        if ids:
            yield group(ids, tokens)
        ids, tokens = [], []
        released()

    return plain.mapInArrow(run, f"ids binary, n_ids int, cu_seqlens array<int>, positions array<int>, doc_ids array<{kind.simpleString()}>, offsets array<bigint>")


def write_packed(docs: DataFrame, path: str, **how) -> None:
    """The packed rows as Parquet files at ``path``: the ``ids`` of a file, one after another, are a matrix of 32-bit ids."""
    packed(docs, **how).write.mode("overwrite").parquet(path)


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
