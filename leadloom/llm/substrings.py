"""Exact removal of long repeated byte strings, across and within documents.

Every string of ``length`` bytes (200) is assigned to its anchor: the least
hash among its ``GRAM``-byte grams. Equal strings have equal anchors wherever
they are, so repeated strings can be sought anchor by anchor, and an anchor
that occurs once in the corpus has none. Successive strings with the same
anchor form a run; a run and the bytes its strings cover are a block.

1. Runs of all texts are found in Python (one for some 80 bytes) and written:
   text, place, anchor, and a digest of the block of 128 bits.
2. Anchors that occur once are dropped (counts are summed up before the
   shuffle). Blocks that are equal throughout are repeated as a whole, and are
   one representative from here on, however many copies there are.
3. Of anchors with different blocks the bytes of one representative of each
   block are fetched, and a Burrows-Wheeler transform of the blocks, extended
   backward in breadth, yields the strings that occur elsewhere (``bwt.py``).
   Blocks of many anchors share a transform of bounded size.
4. An anchor with more than ``HOT`` different blocks (a passage that very many
   documents share) would not fit a transform. Its strings themselves, byte by
   byte, are the key of a count instead, which Spark sums up before the shuffle
   and spreads over all tasks; the result is the same.
5. Ranges go back to the texts, which are rewritten without covered bytes.

Strings of different blocks are compared in bytes. Texts and blocks are taken
for equal where digests of 96 and 128 bits are, the latter within an anchor.
All counts cover all documents. Joins are equi-joins that Spark can split where
a key is hot; no group is collected for an anchor, a passage or a copy.

Cases: a null text counts as empty; texts shorter than ``length`` keep all
bytes; very long texts are read whole, in segments; repeated rows are repeated
text; a null doc_id is kept; an empty table gives an empty result; unnamed
columns are ignored. The remaining bytes need not be valid UTF-8 (a span can
begin inside a character), hence they are returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .common import table, written
from .shingles import mixed

LENGTH, GRAM, HOT = 200, 40, 16_000
#: Strings in a run, strings of a text handled at a time, and bytes of blocks in one transform.
RUN, SEGMENT, CHUNK = 256, 1 << 19, 1 << 20
_LOW = np.uint64((1 << 20) - 1)
_ODD = 0x9E3779B97F4A7C15
_OTHER = 0xC2B2AE3D27D4EB4F
#: Numbers for bytes, of two independent hashes.
_BYTES = mixed(np.arange(512, dtype=np.uint64)).reshape(2, 256)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if odd not in _powers or len(_powers[odd][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        factors = [np.full(size, base, np.uint64) for base in (odd, pow(odd, -1, 1 << 64))]
        for f in factors:
            f[0] = 1
        _powers[odd] = tuple(np.cumprod(f) for f in factors)
    up, down = _powers[odd]
    return up[:n], down[:n]


def _sums(part: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power((_ODD, _OTHER)[which], len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTES[which][part] * up[:-1], out=sums[1:])
    return sums, down


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and anchor (int64) and block digest (two uint64) of every run of ``data``.

    Place: first start, then a bit that is set if the run may repeat a string by itself, then 9 bits for the number of starts.
    """
    out = []
    whole = np.frombuffer(data, np.uint8)
    width = length - gram + 1  # grams of a string
    for begin in range(0, len(data) - length + 1, SEGMENT):
        part = whole[begin : begin + SEGMENT + length - 1]
        n = len(part) - length + 1
        sums, down = _sums(part)
        grams = len(part) - gram + 1
        least = mixed((sums[gram : gram + grams] - sums[:grams]) * down[:grams])
        least = (least & ~_LOW) | np.arange(grams, dtype=np.uint64)  # 44 bits of hash, 20 of place: the left-most of equals
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        least, at = least[:n] >> np.uint64(20), least[:n] & _LOW
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        # long runs (texts of short period) are cut; that only moves their ends
        size = np.diff(np.append(first, n))
        parts = -(-size // RUN)
        first = np.repeat(first, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.diff(np.append(first, n))
        end = first + size + length - 1
        other, fall = _sums(part, 1)
        block = np.column_stack([mixed(mixed((s[end] - s[first]) * d[first]) ^ size.astype(np.uint64)) for s, d in ((sums, down), (other, fall))])
        # strings of one run can be equal only if the anchor moves within it
        moves = at[first] != at[first + size - 1]
        out.append(((first + begin << 10) + (moves.astype(np.int64) << 9) + size, least[first].astype(np.int64), block))
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty((0, 2), np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def text_key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=12).digest()


def _digests(block: np.ndarray) -> pa.Array:
    """Rows of two numbers as 16 bytes each."""
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(block), [None, pa.py_buffer(np.ascontiguousarray(block))])
    return fixed.cast(pa.binary())


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], []]
            size = 0

            def flush():
                key, place, anchor, block = columns
                keys = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(key)), [len(x) for x in place])), pa.array(key, pa.binary())).cast(pa.binary())
                return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(place)), pa.array(np.concatenate(anchor)), _digests(np.concatenate(block))], names=["key", "place", "anchor", "block"])

            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                if len(data) < length:
                    continue
                for column, value in zip(columns, (text_key(data), *runs(data, length))):
                    column.append(value)
                size += len(data)
                if size > 8_000_000:
                    yield flush()
                    columns, size = [[], [], [], []], 0
            if columns[0]:
                yield flush()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way through shuffles, with their keys."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data = [(x.as_py() or "").encode() for x in batch.column("text")]
        new = [pa.array([text_key(x) for x in data], pa.binary()), pa.array([squeeze(x) for x in data], pa.binary())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names[:-1]], *new], names=[*batch.schema.names[:-1], "key", "packed"])


def _bytes_of(length: int):
    """Blocks of the places that are wanted of each text; copies of a text follow each other and are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        last = None
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column("key")[k].as_py()
                if key == last:
                    continue
                last = key
                data = expand(batch.column("packed")[k].as_py())
                wanted = batch.column("wanted")[k].as_py()
                cut = [(x["place"] >> 10, x["place"] & 511) for x in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in wanted], kind) for c, kind in (("anchor", pa.int64()), ("block", pa.binary()))] + [pa.array([data[s : s + n + length - 1] for s, n in cut], pa.binary())],
                    names=["anchor", "block", "bytes"],
                )

    return run


_RANGES = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _as_ranges(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > 1)
    return [{"low": int(a), "high": int(b)} for a, b in zip(starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)])]


def _transformed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, blocks, texts, size = [], [], [], 0

        def flush():
            found = [(a, b, r) for a, b, x in zip(anchors, blocks, repeated_starts(texts, length)) if (r := _as_ranges(x))]
            kinds = (pa.int64(), pa.binary(), _RANGES)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names=["anchor", "block", "ranges"])

        for batch in batches:
            for a, b, x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "bytes"))):
                if size >= CHUNK and a != anchors[-1]:
                    yield flush()
                    anchors, blocks, texts, size = [], [], [], 0
                anchors.append(a)
                blocks.append(b)
                texts.append(x)
                size += len(x)
        if texts:
            yield flush()

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "bytes"))):
                n = len(x) - length + 1
                each = pa.array([x[k : k + length] for k in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a)), pa.array([b] * n, pa.binary()), each, pa.array(np.arange(n, dtype=np.int32))], names=["anchor", "block", "string", "at"])

    return run


def _rewritten(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for packed, marks in zip(batch.column("packed"), batch.column("marks")):
                data = expand(packed.as_py())
                parts, end, spans = [], 0, 0
                gone = 0
                for low, high in sorted(((m["place"] >> 10) + r["low"], (m["place"] >> 10) + r["high"] + length) for m in marks.as_py() or () for r in m["ranges"]):
                    if low > end or not spans:
                        parts.append(data[end:low])
                        spans += 1
                        gone += high - low
                    else:
                        gone += max(0, high - end)
                    end = max(end, high)
                parts.append(data[end:])
                n_bytes.append(len(data))
                n_removed.append(gone)
                n_spans.append(spans)
                kept.append(b"".join(parts))
            new = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *new], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _moves(place: str):
    return F.shiftright(place, 9) % 2


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``doc_id``, n_bytes, n_removed, n_spans long and kept binary (the remaining bytes), one row per row of ``docs``."""
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = plain.schema["id"].dataType.simpleString()
    all_runs = written(plain.select("text").mapInArrow(_runs(length), "key binary, place bigint, anchor bigint, block binary"))
    shared = all_runs.groupBy("anchor").agg(F.sum(1 + _moves("place")).alias("n")).filter("n > 1").select(F.col("anchor").alias("a"))
    repeated = written(all_runs.join(shared, F.col("anchor") == F.col("a")).drop("a"))

    # one representative of each block
    kinds = repeated.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("of"))
    kinds = written(kinds)
    own = F.max(F.when(F.col("n") == 1, _moves("of.place")).otherwise(0))
    by_anchor = kinds.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("n_blocks"), own.alias("own")).filter("n_blocks > 1 OR own = 1")
    mixed_kinds = kinds.join(by_anchor, F.col("anchor") == F.col("a")).select("anchor", "block", "of.key", "of.place", "n_blocks")
    wanted = mixed_kinds.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("anchor", "block", "place")).alias("wanted"))
    packed = plain.mapInArrow(_packed, f"id {id_type}, key binary, packed binary")
    blocks = packed.join(wanted, F.col("key") == F.col("k")).select("key", "packed", "wanted").mapInArrow(_bytes_of(length), "anchor bigint, block binary, bytes binary")
    hot_anchors = by_anchor.filter(F.col("n_blocks") > hot).select("a")
    blocks = written(blocks.join(hot_anchors, F.col("anchor") == F.col("a"), "left").withColumn("hot", F.col("a").isNotNull()).drop("a"))

    ranges = "anchor bigint, block binary, ranges array<struct<low:int,high:int>>"
    some = blocks.filter("NOT hot").select("anchor", "block", "bytes").repartition("anchor").sortWithinPartitions("anchor", "block")
    found = some.mapInArrow(_transformed(length), ranges)
    strings = blocks.filter("hot").select("anchor", "block", "bytes").mapInArrow(_strings(length), "anchor bigint, block binary, string binary, at int")
    twice = strings.groupBy("anchor", "string").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("anchor").alias("a"), F.col("string").alias("s"))
    single = strings.join(twice, (F.col("anchor") == F.col("a")) & (F.col("string") == F.col("s"))).groupBy("anchor", "block").agg(
        F.collect_list(F.struct(F.col("at").alias("low"), F.col("at").alias("high"))).alias("ranges")
    )
    part = found.unionByName(single)
    full = kinds.filter("n > 1").select("anchor", "block", F.array(F.struct(F.lit(0).alias("low"), ((F.col("of.place") % 512) - 1).cast("int").alias("high"))).alias("ranges"))
    part = part.join(full.select(F.col("anchor").alias("a"), F.col("block").alias("b")), (F.col("anchor") == F.col("a")) & (F.col("block") == F.col("b")), "left_anti")
    every = part.unionByName(full).select(F.col("anchor").alias("a"), F.col("block").alias("b"), "ranges")

    marked = repeated.join(every, (F.col("anchor") == F.col("a")) & (F.col("block") == F.col("b"))).groupBy("key", "place").agg(F.first("ranges").alias("ranges"))
    marks = marked.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("place", "ranges")).alias("marks"))
    out = packed.join(marks, F.col("key") == F.col("k"), "left").select("id", "packed", "marks")
    out = out.mapInArrow(_rewritten(length), f"id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", doc_id)


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 200 bytes, counted.
OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), n AS (
  SELECT rid, doc_id, b, octet_length(b) AS size FROM d
), w AS (
  SELECT rid, i, array_slice(b, i + 1, i + 200) AS s FROM (SELECT rid, b, unnest(range(size - 199)) AS i FROM n WHERE size >= 200)
), twice AS (
  SELECT s FROM w GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM w SEMI JOIN twice USING (s)
), run AS (
  SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM hit
), gone AS (
  SELECT rid, k, min(i) AS low, max(i) + 200 AS high FROM run GROUP BY rid, k
), piece AS (
  SELECT rid, coalesce(lag(high) OVER (PARTITION BY rid ORDER BY low), 0) AS a, low AS z FROM gone
  UNION ALL SELECT rid, max(high), CAST(NULL AS BIGINT) FROM gone GROUP BY rid
), kept AS (
  SELECT rid, string_agg(hex(array_slice(b, a + 1, coalesce(z, size))), '' ORDER BY a) AS h FROM piece JOIN n USING (rid) WHERE coalesce(z, size) > a GROUP BY rid
), total AS (
  SELECT rid, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gone GROUP BY rid
)
SELECT doc_id, size AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256
FROM n LEFT JOIN total USING (rid) LEFT JOIN kept USING (rid)
"""
