"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item leaks into a document if some run of the document's words is within
``floor((1 - similarity) * words of the item)`` word edits of the whole item.
Words are split at white space, in lower case, without punctuation at the ends.

1. Windows. If an item occurs within K edits, one of K + 1 parts of it is
   unchanged, so it shares a run of ``q`` words with the document, where q
   follows from length and K (3 at most, less for short items). Such runs are
   looked up for all positions of a text at once; each proposes the item-sized
   window at its offset. K edits leave all but K * q of an item's runs, and
   shift none by more than K words, so a window counts only if so many runs
   are shared around it: a phrase that many items have proposes none of them.
   This loses no leak and leaves few windows.
2. CGK. A window is read by a walk that copies the word under its pointer and
   moves on or stays by a random bit of (step, word). Equal words move alike,
   so edit distance becomes Hamming distance of the copies. ``reps`` walks.
3. LSH. From each walk ``tables`` keys of ``bits`` sampled positions are
   compared with those of the item; windows with an equal key are verified
   first. No keys find every leak at the greatest distance (the walks of long
   items drift apart), so the keys set the order only and drop no window.
4. Windows are verified by their exact edit distance (free ends in the text
   around the window). One is left out only where it cannot count: the words of
   the item that the text around it lacks are a lower bound of its distance,
   which must not exceed the edits allowed, nor the least distance known.
   The result is that of verifying every window.

The benchmark is used in blocks of about ``block_bytes`` of text, and
``pass_blocks`` of them go to the executors for a pass over the texts. A larger
benchmark takes several passes, with the rows written in between, so neither
the driver nor an executor holds more than a pass. Texts are never shuffled or
collected.

Cases: null texts and items count as empty; an empty item leaks nowhere;
texts are searched whole, in groups of bounded size; repeated rows stay and are
judged alike; repeated items each give their links; null ids are kept; empty
tables give an empty result; columns of the input are kept, but __leaks takes
the place of one with its name, and the stage returns all columns as they came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, other_names, released, table, written
from .shingles import hashes_of, mixed

REPS, TABLES, BITS = 16, 8, 3
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_"
_BIG = np.uint64(0xD1342543DE82EF95)


def words(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(EDGES))]


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    if len(h) < q:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - q + 1, np.uint64)
    for k in range(q):
        out = mixed(out ^ h[k : len(h) - q + 1 + k])
    return out


def fit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any run of ``region``, and where the best run ends."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for x in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (region != x))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def least_distance(item: np.ndarray, region: np.ndarray) -> int:
    """A lower bound of ``fit_distance``: each word that the region lacks is an edit."""
    return int(len(item) - np.isin(item, region).sum())


class Detector:
    def __init__(self, items: list[tuple[object, str | None]], similarity: float = 0.8, reps: int = REPS, tables: int = TABLES, bits: int = BITS):
        self.reps, self.tables, self.bits = reps, tables, bits
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.ids = [i for i, _ in split]
        self.words = [hashes_of(w) for _, w in split]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        whole = -(-(self.size - self.edits) // (self.edits + 1))
        self.q = np.minimum(3, np.maximum(1, whole))
        self.longest = int(self.size.max(initial=0))
        rng = np.random.default_rng(20240501)
        self.turn = rng.integers(0, 2**63, size=(2 * self.longest + 1, reps), dtype=np.int64).astype(np.uint64)
        self.pick = rng.random((reps, tables, bits))
        # runs of q words: sorted hashes with item and offset
        self.runs = {}
        for q in sorted(set(self.q.tolist())):
            parts = [(k, _grams(self.words[k], q)) for k in np.flatnonzero(self.q == q)]
            gram = np.concatenate([g for _, g in parts])
            item = np.concatenate([np.full(len(g), k) for k, g in parts])
            offset = np.concatenate([np.arange(len(g)) for _, g in parts])
            order = np.argsort(gram, kind="stable")
            self.runs[q] = gram[order], item[order], offset[order]
        self.item_keys = np.empty((len(self.words), reps * tables), np.uint64)
        for at in range(0, len(self.words), 512):
            which = np.arange(at, min(at + 512, len(self.words)))
            self.item_keys[which] = self._keys(self._padded([self.words[k] for k in which]), which)

    def _padded(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), self.longest + 1), np.uint64)
        for k, row in enumerate(rows):
            out[k, : len(row)] = row
        return out

    def _keys(self, windows: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The LSH keys of windows, sampled where those of their items are."""
        n = len(windows)
        size = self.size[item]
        reach = np.maximum(1, (1.7 * size).astype(np.int64))
        steps = int(reach.max())
        at = np.zeros((n, self.reps), np.int64)
        rows = np.arange(n)[:, None]
        copies = np.empty((steps, n, self.reps), np.uint64)
        for j in range(steps):
            seen = windows[rows, at]
            copies[j] = seen
            at = np.minimum(at + (mixed(seen ^ self.turn[j]) >> np.uint64(63)).astype(np.int64), self.longest)
        out = np.empty((n, self.reps * self.tables), np.uint64)
        for r in range(self.reps):
            for t in range(self.tables):
                key = np.zeros(n, np.uint64)
                for b in range(self.bits):
                    key = mixed(key ^ copies[(self.pick[r, t, b] * reach).astype(np.int64), np.arange(n), r])
                out[:, r * self.tables + t] = key
        return out

    def windows(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows (text, item, first word counted from the start of all texts) of the proposed windows."""
        found = []
        span = len(h) + 2 * self.longest + 2
        for q, (gram, item, offset) in self.runs.items():
            own = _grams(h, q)
            lo = np.searchsorted(gram, own)
            hit = np.flatnonzero(gram[np.minimum(lo, len(gram) - 1)] == own)
            if not len(hit):
                continue
            doc = np.searchsorted(ends, hit, side="right")
            inside = hit + q <= ends[doc]
            hit, doc = hit[inside], doc[inside]
            lo, hi = lo[hit], np.searchsorted(gram, own[hit], side="right")
            count = hi - lo
            pos = np.repeat(hit, count)
            entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            doc, which, start = np.repeat(doc, count), item[entry], pos - offset[entry]
            # runs that are shared within 2 K words of where this one puts the item
            key = (doc * len(self.words) + which) * span + start + self.longest
            order = np.argsort(key)
            key, doc, which, start = key[order], doc[order], which[order], start[order]
            reach = 2 * self.edits[which]
            near = np.searchsorted(key, key + reach, side="right") - np.searchsorted(key, key - reach)
            keep = near >= self.size[which] - q + 1 - q * self.edits[which]
            found.append(np.column_stack([doc[keep], which[keep], start[keep]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def detect(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.words):
            return out
        flat: list[str] = []
        ends = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            flat += words(text)
            ends[k] = len(flat)
        h = hashes_of(flat)
        starts = np.concatenate([[0], ends[:-1]])
        proposed = self.windows(h, ends)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for at in range(0, len(proposed), 2048):
            part = proposed[at : at + 2048]
            rows = [h[max(s, starts[d]) : min(s + self.size[i], ends[d])] for d, i, s in part]
            equal = (self._keys(self._padded(rows), part[:, 1]) == self.item_keys[part[:, 1]]).any(axis=1)
            for d, i, s in [*part[equal].tolist(), *part[~equal].tolist()]:
                known = best.get((d, i))
                if known and known[0] == 0:
                    continue
                slack = int(self.edits[i]) + 1
                first = max(s - slack, int(starts[d]))
                region = h[first : min(s + int(self.size[i]) + slack, int(ends[d]))]
                if least_distance(self.words[i], region) > (known[0] if known else self.edits[i]):
                    continue
                distance, end = fit_distance(self.words[i], region)
                found = distance, first + end - int(starts[d])
                if distance <= self.edits[i] and (known is None or found < known):
                    best[d, i] = found
        for (d, i), (distance, end) in sorted(best.items()):
            out[d].append({"item_id": self.ids[i], "n_edits": distance, "end_word": end})
        return out


def _leak_type(item_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item_type), T.StructField("n_edits", T.LongType()), T.StructField("end_word", T.LongType())]))


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, block_bytes: int = 4_000_000, pass_blocks: int = 8
) -> DataFrame:
    """``docs`` with __leaks array<struct<item_id, n_edits, end_word>> added (in place of such a column): the items that occur in each whole text."""
    from pyspark.sql.pandas.types import to_arrow_type

    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text"))
    kind = _leak_type(items.schema["id"].dataType)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    names = other_names(docs.columns, ("__leaks",))
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.array().cast(kind).alias("__leaks"))
    schema = out.schema
    arrow = to_arrow_type(kind)
    context = docs.sparkSession.sparkContext
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    for first in range(0, n_blocks, pass_blocks):
        blocks: dict[int, list] = {}
        for r in items.filter(F.col("block").between(first, first + pass_blocks - 1)).collect():
            blocks.setdefault(r.block, []).append((r.id, r.text))
        shared = context.broadcast(list(blocks.values()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            detectors = [Detector(block, similarity) for block in shared.value]
            for part, texts in in_batches(batches, text, 1024, 2_000_000):
                found = part.column("__leaks").to_pylist()
                for detector in detectors:
                    found = [a + b for a, b in zip(found, detector.detect(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, arrow)], names=part.schema.names)
            detectors.clear()
            released()

        out = out.mapInArrow(run, schema)
        if first + pass_blocks < n_blocks:
            out = written(out)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("__leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.n_edits", "leak.end_word")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, with all their columns as they came."""
    # one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("__none")).alias("__row"), "text")
    clean = leaks(rows, table(spark, sf_dir, "benchmark")).filter(F.size("__leaks") == 0)
    return clean.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
