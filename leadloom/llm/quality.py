"""Quality rules with host-level verdicts (DataFrame functions only).

Every document is measured in its own row, without exploding it: words are
runs of ``[^\\x20\\x09-\\x0D]``, and repeated three-word windows are found by
sorting the windows with their positions and comparing neighbours, which is
O(n log n) for a text of n words.

Rules: too few words, repetition, too many symbols, repeated lines, and words
of a strange mean length. The first two are the base rules of a document; all
of them are held against its host.

Hosts: failures of each rule are counted by domain (here the ``source`` of a
document) and shrunk with an empirical beta prior of that rule. Its mean is
the rate over all documents; its strength comes from how much the rates of
hosts vary beyond the noise of counting (weighted moments, see ``_prior``), so
that a host of few documents stays near the mean while many hosts of one
document each don't pass their noise for variation. A host whose shrunk rate
of some rule exceeds ``max_host_rate`` is rejected with all its documents.

The measures go to a table in the shared folder, since two things read them:
the counts by host (partial sums before the shuffle, so a hot host is one row
per task) and the join that brings verdicts back. Verdicts are broadcast if
their measured bytes are few; beyond that Spark shuffles both sides and splits
skewed partitions.

Cases: a null text has no words and fails; texts are measured whole; documents
with a null host are judged by their own rules only, and are no part of the
prior; repeated rows count and stay; where nothing can be said of how hosts
vary (a single host, a document each) the prior has the strength
``flat_prior``; an empty table gives an empty result. Columns of the input are
kept, but a measure takes the place of one with its name; the stage returns
all columns as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import other_names, small_side, table, written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
BASE_RULES = ("short", "repetitive")
#: A prior counts as so many documents at least, however much hosts vary: one document alone says little.
LEAST_PRIOR = 2.0


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` names it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    core = F.btrim(text, F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, "[ \\t-\\r]+", -1))


def _repeated(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""
    last = F.size(words) - 3

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))

    def again(s: Column) -> Column:
        def hit(x: Column, i: Column) -> Column:
            return (F.get(s, i - 1)["w"] == x["w"]) | (F.get(s, i + 1)["w"] == x["w"])

        return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(hit(x, i), F.lit(False))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), last), window))
    return F.when(last < 0, F.lit(0).cast("bigint")).otherwise(_bound(windows, lambda s: _bound(again(s), covered)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five measures of each whole text, n_lines and base_failed; the text itself is left out."""
    new = (*MEASURES, "n_lines", "base_failed")
    names = other_names([c for c in docs.columns if c != text], new)
    plain = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    count = lambda chars: F.length("__text") - F.length(F.translate("__text", chars, ""))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    plain = plain.withColumn("__words", words_of(F.col("__text")))
    out = plain.withColumns({
        "__m": _bound(F.col("__words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))),
        "word_chars": F.length(F.translate("__text", SPACE, "")).cast("long"),
        "n_symbols": count(SYMBOLS).cast("long"),
        "__l": _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
    })
    out = out.withColumns({k: F.col(f"{c}.{k}") for c, k in (("__m", "n_words"), ("__m", "n_repeat_words"), ("__l", "n_lines"), ("__l", "n_dup_lines"))})
    out = out.withColumn("base_failed", F.expr(" OR ".join(RULES[k] for k in BASE_RULES)))
    return out.select(*[F.col(f"`{c}`") for c in (*names, *new)])


def _prior(hosts: DataFrame, flat_prior: float) -> dict[str, tuple[float, float | None]]:
    """(mean, strength) for each rule, a few numbers however many hosts there are; a strength of None is one beyond all bounds.

    With n documents and f failures in each of H hosts, N and m = F / N of all,
    the sum S of n (f/n - m)^2 is expected to be m (1 - m) ((H - 1) + rho (N -
    sum(n^2)/N - (H - 1))), where the strength of the prior is 1/rho - 1.
    """
    n = F.col("n_docs").cast("double")
    total = F.sum(n)
    spread = total - F.sum(n * n) / total - (F.count("*") - 1)
    rules = []
    for k in RULES:
        f = F.col(f"f_{k}").cast("double")
        m = F.sum(f) / total
        s = F.sum(f * f / n) - F.sum(f) * F.sum(f) / total
        rules.append(F.struct(m.alias("mean"), F.when((spread > 1e-9) & (m > 0) & (m < 1), (s / (m * (1 - m)) - (F.count("*") - 1)) / spread).alias("rho")).alias(k))
    moments = hosts.agg(*rules).first()

    def strength(rho: float | None) -> float | None:
        return flat_prior if rho is None else max(1 / rho - 1, LEAST_PRIOR) if rho > 1e-9 else None

    return {k: (moments[k]["mean"], strength(moments[k]["rho"])) for k in RULES}


def host_verdicts(measured: DataFrame, host: str = "source", max_host_rate: float = 0.5, flat_prior: float = 10.0) -> DataFrame:
    """host, n_docs, failures f_<rule> and shrunk rates r_<rule>, shrunk_rate (the greatest) and rejected, one row per host that is not null."""
    hosts = (
        measured.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n_docs"), *[F.count_if(F.expr(rule)).alias(f"f_{k}") for k, rule in RULES.items()])
    )
    prior = _prior(hosts, flat_prior)

    def rate(k: str) -> Column:
        mean, strength = prior[k]
        if mean is None or strength is None:
            return F.lit(mean).cast("double")
        return (F.col(f"f_{k}") + mean * strength) / (F.col("n_docs") + strength)

    out = hosts.withColumns({f"r_{k}": rate(k) for k in RULES})
    out = out.withColumn("shrunk_rate", F.greatest(*[f"r_{k}" for k in RULES]))
    return out.withColumn("rejected", F.col("shrunk_rate") > max_host_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """``docs`` without the text, with the measures, base_failed, host_rate and kept."""
    plain = docs.withColumn("__host", F.col(f"`{host}`"))
    measured = written(measure(plain, text))
    verdicts = host_verdicts(measured, "__host", max_host_rate).select(F.col("host").alias("__h"), F.col("shrunk_rate").alias("__rate"), F.col("rejected").alias("__rejected"))
    out = measured.join(small_side(verdicts), F.col("__host") == F.col("__h"), "left")
    names = other_names([c for c in measured.columns if c != "__host"], ("host_rate", "kept"))
    kept = ~F.col("base_failed") & ~F.coalesce("__rejected", F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("__rate").alias("host_rate"), kept.alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", *MEASURES, "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host is not rejected, with all their columns.

    The judged documents are written once with their columns; only the hosts
    that are rejected meet them again, so no text is shuffled unless those
    hosts are too many to broadcast.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("source").alias("__source"), F.col("text").alias("__copy"))
    judged = written(measure(rows, "__copy"))
    bad = small_side(host_verdicts(judged, "__source").filter("rejected").select(F.col("host").alias("__host")))
    kept = judged.filter(~F.col("base_failed")).join(bad, F.col("__source") == F.col("__host"), "left_anti")
    return kept.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


_OP4_BODY = r"""
d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), tri AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY rid
), m AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), r AS (
  SELECT source, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > word_chars, 10 * n_dup_lines > 3 * n_lines,
    word_chars < 2 * n_words OR word_chars > 12 * n_words]) AS failed, unnest(range(5)) AS rule
  FROM b WHERE source IS NOT NULL
), h AS (
  SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS f FROM r GROUP BY source, rule
), mo AS (
  SELECT rule, sum(f) / sum(n) AS m, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS spread, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS s, count(*) AS k
  FROM h GROUP BY rule
), rh AS (SELECT rule, m, CASE WHEN spread > 1e-9 AND m > 0 AND m < 1 THEN (s / (m * (1 - m)) - (k - 1)) / spread END AS rho FROM mo),
st AS (SELECT rule, m, CASE WHEN rho IS NULL THEN 10.0 WHEN rho > 1e-9 THEN greatest(1 / rho - 1, 2) END AS s FROM rh),
hv AS (SELECT source, max(CASE WHEN s IS NULL THEN m ELSE (f + m * s) / (n + s) END) AS host_rate FROM h JOIN st USING (rule) GROUP BY source)
"""

OP4_SQL = f"""
WITH {_OP4_BODY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_rate > 0.5, false) AS kept, round(host_rate, 9) AS host_rate
FROM b LEFT JOIN hv USING (source)
"""
