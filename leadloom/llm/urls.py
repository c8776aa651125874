"""URL filters by host-suffix and path-prefix expressions.

Rules are (host, path, verdict). A rule fits its host and all subdomains, if
the path of the url starts with the rule's path. Every url is expanded into
the host suffixes and path prefixes that a rule can have: all suffixes that
start at a label, with prefixes of the lengths that occur among rules for
that many characters of host. No expression that could match is left out.

Expressions are joined with the rules on the first eight hex digits of their
SHA-256, then the full digest is compared, then precedence picks one rule:
the longest host + path, then the longest host, then block before allow.

Distinct (host, path) pairs are judged once, so a url that a third of the
pages share costs one expansion, and only pairs that some rule fits come back
to the pages. Joins are plain equi-joins: Spark sends the rules to every
executor only below its own size threshold, measured at run time, and splits
skewed partitions of pages beyond it.

Cases: a null url or one without ``://`` has empty host and path and gets the
default verdict unless a rule has an empty host; urls are read whole, however
long; repeated rows stay; an empty table of pages or rules is allowed; all
columns of the pages are kept, but a new column (host, path, rule, verdict)
takes the place of one with its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import other_names, table

RULE_SCHEMA = T.StructType([T.StructField(n, T.StringType(), False) for n in ("host", "path", "verdict")])

#: Fixed values of the query's rule list.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # no host holds a slash, and no path starts with anything else
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host + path, null if none fits) and verdict added."""
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.coalesce("verdict", F.lit(default)).alias("r_verdict"),
    ).distinct()
    # the shapes of rules: at most (longest host) x (longest path) pairs of numbers, however many rules there are
    shapes = [(r.h, r.p) for r in rules.select(F.length("r_host").alias("h"), F.length("r_path").alias("p")).distinct().collect()]
    by_host: dict[int, list[int]] = {}
    for h, p in sorted(shapes):
        by_host.setdefault(h, []).append(p)
    rules = rules.withColumns({"r_digest": _digest(F.col("r_host"), F.col("r_path"))})
    rules = rules.withColumn("short", F.substring("r_digest", 1, 8))

    names = other_names(pages.columns, ("host", "path", "rule", "verdict"))
    rows = pages.select(*[F.col(f"`{c}`") for c in names], host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    keys = rows.select(F.col("__host").alias("host"), F.col("__path").alias("path")).distinct()
    n = F.length("host")

    def expand(h: int, paths: list[int]) -> Column:
        suffix = F.substr(F.col("host"), n - h + 1)
        fits = F.filter(F.array(*[F.lit(p) for p in paths]), lambda p: p <= F.length("path"))
        at_label = (n == h) | ((n > h) & (F.substr(F.col("host"), n - h, F.lit(1)) == "."))
        return F.when(at_label, F.transform(fits, lambda p: F.struct(suffix.alias("h"), F.substr(F.col("path"), F.lit(1), p).alias("p"))))

    pieces = [expand(h, paths) for h, paths in by_host.items()]
    if pieces:
        all_pieces = F.flatten(F.array_compact(F.array(*pieces)))
    else:
        all_pieces = F.array().cast("array<struct<h:string,p:string>>")
    expressions = keys.select("host", "path", F.explode(all_pieces).alias("e"))
    expressions = expressions.select("host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("digest"))
    hits = expressions.withColumn("short", F.substring("digest", 1, 8)).join(rules, "short").filter(F.col("digest") == F.col("r_digest"))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host_length"),
        (F.col("r_verdict") == "block").alias("block"),
    )
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best")
    )
    best = best.select(F.col("host").alias("__b_host"), F.col("path").alias("__b_path"), F.col("best").alias("__best"))
    out = rows.join(best, (F.col("__host") == F.col("__b_host")) & (F.col("__path") == F.col("__b_path")), "left")
    return out.select(
        *[rows[f"`{c}`"] for c in names],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), judged AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) k, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
)
SELECT page_id, parsed.host, parsed.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN judged USING (host, path)
"""
