"""Dashboard: grouped counts and recent leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = {"status": "lead_status", "channel": "ai_source_channel", "owner": "contact_owner", "lifecycle": "lifecycle_stage"}


def counts_by(leads: DataFrame, column: str) -> DataFrame:
    """value, n without null and blank values."""
    return leads.filter(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def all_counts(leads: DataFrame) -> DataFrame:
    """axis, value, n of all four axes in one scan."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("value")) for a, c in AXES.items()])
    rows = leads.select(F.explode(pairs).alias("x")).select("x.axis", "x.value").filter("value <> ''")
    return rows.groupBy("axis", "value").agg(F.count("*").alias("n"))


def totals(leads: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """total and recent (created in the last ``days`` days before ``as_of``), one row."""
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    return leads.agg(F.count("*").alias("total"), F.count_if(F.col("original_create_date") >= since).alias("recent"))


def dashboard(leads: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row: totals, and a map of counts for each axis."""
    maps = all_counts(leads).groupBy("axis").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("counts"))
    pick = [F.first(F.when(F.col("axis") == a, F.col("counts")), ignorenulls=True).alias(f"by_{a}") for a in AXES]
    one = maps.agg(*pick).withColumn("k", F.lit(1))
    return totals(leads, as_of, days).withColumn("k", F.lit(1)).join(one, "k").drop("k")
