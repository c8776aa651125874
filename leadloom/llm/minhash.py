"""Near-duplicates by BagMinHash: weighted Jaccard of bags of five-word shingles.

Signatures. Every shingle starts Poisson processes over the axis of weights:
one of rate 1 on [0, 1), and one for each interval [2^(j-1), 2^j) that its
count reaches into, with the length of the interval as rate. A point of a
process falls on a whole-numbered cell of its interval by further hash bits
(the splits of the interval down to one cell, drawn at once) and counts only
if that cell lies below the shingle's count. Points come in ascending order
and go to a random register; a register keeps its first point. All of it is a
function of the shingle alone, so two bags agree in a register with a chance
of exactly their weighted Jaccard similarity. Points are drawn up to a limit
at which most registers are full, then further for bags with an empty one.

Candidates. Signatures are cut into bands; documents that agree in a band
share a bucket. 40 bands of 8 find a pair of similarity 0.8 with a chance of
0.9994, 0.85 with 0.99999. Exact copies are one node from the start.

Links. A bucket emits no pairs within the group. Every member is compared with
one center of its bucket, links give components, and members of buckets that
still hold several components are compared with another center, ``STARS``
times. Buckets that are still open may hide a link between components. Their
documents go through an exact filter: shingles are put in one order for all,
rarest first, and two bags of similarity t or more share a shingle among the
first few of each, as many as their sizes leave room for. Only pairs of
different components that do are compared. A document whose edits alone exceed
that room, the usual case in a large group of loose copies, meets nobody. So
each pair that shares a bucket is in one component, is verified, or cannot
reach the threshold, and classes are those of the graph of all such links.
The order comes from a histogram of 2^18 cells, whose size is fixed; any order
gives the same links.

Verification computes the overlap of both bags of the whole texts: a link has
5 * |intersection| >= 4 * |union| at the threshold of 0.8.

Cases: words are split at white space, in lower case; a text of one to four
words has one shingle, so it matches equal word sequences; texts without words,
null included, are only alike if the very same text (null apart from empty);
repeated rows stay; a null doc_id takes part, and the class id is the least id
that is not null; an empty table gives an empty result; unnamed columns are
ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, released, table, written
from .components import components
from .shingles import bags, mixed, overlap

BANDS, ROWS, STARS = 40, 8, 3
#: Texts are signed in groups of so many characters or documents.
CHUNK_CHARS, CHUNK_DOCS = 800_000, 160


def signatures(found: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``m`` registers (uint64) for each bag; all bags have to hold something."""
    seeds, weight, doc = [], [], []
    for d, (items, counts) in enumerate(found):
        seeds.append(items)
        weight.append(counts)
        doc.append(np.full(len(items), d))
    item, count, doc = np.concatenate(seeds), np.concatenate(weight).astype(np.int64), np.concatenate(doc)
    total = np.bincount(doc, weights=count, minlength=len(found))
    # a process for each interval of weights that the count reaches into
    base, low, size, owner, top = [mixed(item)], [np.zeros(len(item), np.int64)], [np.ones(len(item), np.int64)], [doc], [count]
    j, begin = 1, 1
    while (more := count > begin).any():
        item, count, doc = item[more], count[more], doc[more]
        base.append(mixed(item ^ mixed(np.array([j], dtype=np.uint64))))
        low.append(np.full(len(item), begin))
        size.append(np.full(len(item), begin))
        owner.append(doc)
        top.append(count)
        j, begin = j + 1, begin * 2
    base, low, size, owner, top = (np.concatenate(x) for x in (base, low, size, owner, top))
    rate = size.astype(np.float64)
    limit = m * (math.log(m) + 1.5) / total
    first = np.full(len(found) * m, np.inf)
    sign = np.zeros(len(found) * m, dtype=np.uint64)
    step = np.zeros(len(base), dtype=np.uint64)

    def waits(h: np.ndarray, which: np.ndarray) -> np.ndarray:
        return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[which, None]

    everyone = np.arange(len(base))
    time = waits(mixed(base)[:, None], everyone)[:, 0]
    active = everyone
    while len(active):
        at, codes, keys = [], [], []
        while len(active := active[time[active] <= limit[owner[active]]]):
            # the pending point of each process and those that follow; the sums run in order, so blocks change nothing
            n = 1 if len(active) > 8192 else 16
            hashes = mixed(base[active, None] + (step[active, None] + np.arange(n + 1, dtype=np.uint64)) * np.uint64(0xD1342543DE82EF95))
            times = np.cumsum(np.column_stack([time[active], waits(hashes[:, 1:], active)]), axis=1)
            step[active] += np.uint64(n)
            time[active] = times[:, n]
            row, col = np.nonzero(times[:, :n] <= limit[owner[active], None])
            which = active[row]
            other = mixed(hashes[row, col])
            cell = low[which] + ((other & np.uint64(0xFFFFFFFF)).astype(np.int64) * size[which] >> 32)
            inside = cell < top[which]
            at.append(times[row, col][inside])
            codes.append(other[inside])
            keys.append((owner[which] * m + ((other >> np.uint64(32)).astype(np.int64) * m >> 32))[inside])
        at, codes, keys = (np.concatenate(x) if x else np.empty(0) for x in (at, codes, keys))
        if len(at):
            keys = keys.astype(np.int64)
            np.minimum.at(first, keys, at)
            won = at == first[keys]
            sign[keys[won]] = codes[won]
        short = np.isinf(first).reshape(len(found), m).any(axis=1)
        limit = np.where(short, limit * 1.5, -1.0)
        active = everyone[short[owner]]
    return sign.reshape(len(found), m)


def band_keys(sign: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """int64 bucket of each band of each signature."""
    cut = sign.reshape(len(sign), n_bands, n_rows)
    key = np.broadcast_to(mixed(np.arange(n_bands, dtype=np.uint64)), (len(sign), n_bands)).copy()
    for k in range(n_rows):
        key = mixed(key ^ cut[:, :, k])
    return key.view(np.int64)


def _signed(n_bands: int, n_rows: int):
    def sign(texts: list[str | None]) -> tuple[list[int], list[np.ndarray]]:
        found = bags(texts)
        sizes = [int(c.sum()) for _, c in found]
        full = [i for i, n in enumerate(sizes) if n]
        keys: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
        if full:
            for i, row in zip(full, band_keys(signatures([found[i] for i in full], n_bands * n_rows), n_bands, n_rows)):
                keys[i] = row
        return sizes, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part, texts):
            sizes, keys = sign(texts)
            return pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "doc_id", "size", "buckets"]
            )

        for part, texts in in_batches(batches, "text", CHUNK_DOCS, CHUNK_CHARS):
            yield out(part, texts)
        released()

    return run


def _verified(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, tuple] = OrderedDict()

        def bag(node: bytes, text: str | None):
            if node not in kept:
                kept[node] = bags([text])[0]
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = []
                for a, b, x, y in zip(*(part.column(c) for c in ("a", "b", "text_a", "text_b"))):
                    both, either = overlap(bag(a.as_py(), x.as_py()), bag(b.as_py(), y.as_py()))
                    good.append(either > 0 and both * denominator >= numerator * either)
                yield part.drop_columns(["text_a", "text_b"]).filter(pa.array(good))
        kept.clear()
        released()

    return run


CELLS = 1 << 18


def _tokens(text: str | None) -> np.ndarray:
    """Shingles of a text as a set: the second of equal ones is another token, and so on."""
    items, counts = bags([text])[0]
    if not len(items) or counts.max() == 1:
        return items
    which = np.repeat(np.arange(len(items)), counts)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(turn == 0, items[which], mixed(items[which] ^ mixed(turn.astype(np.uint64))))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            np.add.at(counts, (_tokens(text.as_py()) % np.uint64(CELLS)).astype(np.int64), 1)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])


def _prefixes(shared, numerator: int, denominator: int):
    """The rarest tokens of each text that can decide, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        cells = np.array(shared.value, np.int64).reshape(-1, 2)
        counts[cells[:, 0]] = cells[:, 1]
        for batch in batches:
            node, component, size, token, place = [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                t = _tokens(text.as_py())
                n = len(t)
                first = n - -(-n * numerator // denominator) + 1
                t = t[np.lexsort((t, counts[(t % np.uint64(CELLS)).astype(np.int64)]))][:first]
                node += [k] * len(t)
                size.append(np.full(len(t), n))
                token.append(t.view(np.int64))
                place.append(np.arange(len(t)))
            at = pa.array(node, pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(at), batch.column("component").take(at), *(pa.array(np.concatenate(x)) for x in (size, token, place))],
                    names=["node", "component", "size", "token", "place"],
                )

    return run


def _decisive(texts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """a, b and their components ca, cb: pairs of ``texts`` (node, component, text) of different components that can reach the similarity."""
    cells = texts.select("text").mapInArrow(_histogram, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    # one number for each cell: at most CELLS rows
    shared = texts.sparkSession.sparkContext.broadcast([(r.cell, r.n) for r in cells.collect()])
    prefix = texts.mapInArrow(_prefixes(shared, numerator, denominator), "node binary, component binary, size bigint, token bigint, place bigint")
    both = prefix.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select(F.col("token").alias("t"))
    prefix = written(prefix.join(both, F.col("token") == F.col("t")).drop("t"))
    other = prefix.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "size", "place")])
    # the least overlap that reaches numerator / denominator of the union
    total = numerator + denominator
    need = F.ceil((F.col("size") + F.col("size_b")) * numerator / total)
    near = (F.col("place") <= F.col("size") - need) & (F.col("place_b") <= F.col("size_b") - need)
    pairs = prefix.join(other, "token").filter((F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b")) & near)
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("component").alias("ca"), F.col("component_b").alias("cb")).distinct()


def node_of(text: Column) -> Column:
    """16 bytes that stand for a text; null has its own."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("null"))))


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = (4, 5), n_bands: int = BANDS, n_rows: int = ROWS
) -> DataFrame:
    """node binary, doc_id (the least of the node), class_id (the least of the class), class_node (whose least id it is): one row per text."""
    num, den = similarity
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("node", node_of(F.col("text")))
    id_type = plain.schema["doc_id"].dataType.simpleString()
    signed = plain.mapInArrow(_signed(n_bands, n_rows), f"node binary, doc_id {id_type}, size bigint, buckets array<bigint>")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.min("buckets").alias("buckets")))

    entries = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
    members = written(entries.join(shared, "bucket").withColumn("component", F.col("node")))

    # the text of every node that shares a bucket, once
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node").select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"))
    texts = plain.join(wanted, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    texts = written(texts.groupBy("node", "doc_id").agg(F.first("text").alias("text")).select("node", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        x = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        y = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(y, "b").join(x, "a").select(*pairs.columns, "text_a", "text_b")
        return written(both.mapInArrow(_verified(num, den), pairs.schema))

    # components of nodes so far; what links join is components, so those are the nodes of each further graph
    out = nodes.select("node", "doc_id", F.col("node").alias("component"))

    def joined(rows: DataFrame, links: DataFrame) -> DataFrame:
        top = links.select(F.col("node").alias("c"), F.col("component").alias("top"))
        return rows.join(top, F.col("component") == F.col("c"), "left").withColumn("component", F.coalesce("top", "component")).drop("c", "top")

    def open_(rows: DataFrame, *centers: Column) -> DataFrame:
        """Members of buckets that hold several components."""
        several = rows.groupBy(F.col("bucket").alias("k")).agg(F.min("component").alias("c1"), F.max("component").alias("c2"), *centers).filter("c1 < c2").drop("c1", "c2")
        return rows.join(several, F.col("bucket") == F.col("k")).drop("k")

    for turn in range(STARS):
        center = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node", "size", "component")).alias("center")
        members = open_(members, center)
        c = F.col("center")
        fits = F.least("size", c["size"]) * den >= F.greatest("size", c["size"]) * num
        pairs = members.filter((F.col("component") != c["component"]) & fits)
        pairs = pairs.select(c["node"].alias("a"), F.col("node").alias("b"), c["component"].alias("ca"), F.col("component").alias("cb")).distinct()
        links = components(verified(pairs).select("ca", "cb").distinct(), "ca", "cb")
        out, members = joined(out, links), written(joined(members.drop("center"), links))
    rest = open_(members).select(F.col("node").alias("o"), "component").distinct()
    rest = written(texts.join(rest, F.col("node") == F.col("o")).select("node", "component", "text"))
    out = joined(out, components(verified(_decisive(rest, num, den)).select("ca", "cb").distinct(), "ca", "cb"))
    # a null id comes last, not first
    least = out.groupBy(F.col("component").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"))
    out = out.join(least, F.col("component") == F.col("c"))
    return out.select("node", "doc_id", F.col("least.doc_id").alias("class_id"), F.col("least.node").alias("class_node"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, class_id of every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), node_of(F.col(text).cast("string")).alias("node"))
    found = classes(docs, doc_id, text, **how).select(F.col("node").alias("n"), "class_id")
    return rows.join(found, F.col("node") == F.col("n"), "left").select(F.col("doc_id").alias(doc_id), "class_id")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one of the least doc_id, once if its row is repeated."""
    keep = written(classes(docs.select("doc_id", "text")).filter("node = class_node").select(F.col("node").alias("__n"), F.col("doc_id").alias("__id")))
    keyed = docs.withColumn("__node", node_of(F.col("text")))
    out = keyed.join(keep, (F.col("__node") == F.col("__n")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    # of rows that share id and text the least as a whole, so that a run gives what the last one gave
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return out.groupBy("__node", "doc_id").agg(F.min(row).alias("__row")).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


#: Classes by all pairs of texts that share a shingle.
OP3_SQL = r"""
WITH RECURSIVE node AS (
  SELECT row_number() OVER () AS node, text, min(doc_id) AS least FROM documents GROUP BY text
), w AS (
  SELECT node, list_filter(regexp_split_to_array(lower(text), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '') AS words
  FROM node WHERE text IS NOT NULL
), g AS (
  SELECT node, shingle, count(*) AS n FROM (
    SELECT node, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) AS shingle FROM w WHERE len(words) >= 5
    UNION ALL SELECT node, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4
  ) GROUP BY node, shingle
), size AS (
  SELECT node, sum(n) AS n FROM g GROUP BY node
), common AS (
  SELECT x.node AS a, y.node AS b, sum(least(x.n, y.n)) AS n FROM g x JOIN g y USING (shingle) WHERE x.node < y.node GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size p ON p.node = a JOIN size q ON q.node = b WHERE 5 * common.n >= 4 * (p.n + q.n - common.n)
), edge AS (
  SELECT a AS x, b AS y FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT node AS x, node AS y FROM node UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y
), class AS (
  SELECT x AS node, min(least) AS class_id FROM reach JOIN node ON node.node = y GROUP BY x
)
SELECT doc_id, class_id FROM documents JOIN node ON documents.text IS NOT DISTINCT FROM node.text JOIN class USING (node)
"""
