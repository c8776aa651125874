"""From a CRM export to resolved leads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attribution import attribute_missing
from ..sources.leads import crm_to_leads, read_crm_csv, write_table
from ..storage import exists
from .dedupe import resolve


class Seeded(NamedTuple):
    leads: DataFrame
    imported: bool
    tallies: DataFrame


def seed(spark: SparkSession, csv: str, out: str, extract_sources: bool = True, run_dedup: bool = True, reset: bool = False) -> Seeded:
    """Imports ``csv``, fills sources, resolves duplicates and writes leads and candidates below ``out``.

    Leads that are there already stay and the export is not read, unless
    ``reset``; the two further steps run either way. ``tallies``: step, value,
    n, namely leads, sources by channel, candidates and clusters.
    """
    imported = reset or not exists(spark, f"{out}/imported") or spark.read.parquet(f"{out}/imported").isEmpty()
    if imported:
        write_table(crm_to_leads(read_crm_csv(spark, csv)), f"{out}/imported")
    leads = spark.read.parquet(f"{out}/imported")
    tallies = leads.agg(F.lit("import").alias("step"), F.lit("leads").alias("value"), F.count("*").alias("n"))
    if extract_sources:
        leads = attribute_missing(leads)
        by = leads.groupBy(F.col("ai_source_channel").alias("value")).agg(F.count("*").alias("n"))
        tallies = tallies.unionByName(by.select(F.lit("sources").alias("step"), "value", "n"))
    if run_dedup:
        found = resolve(leads)
        write_table(found.candidates, f"{out}/dedupe_candidates")
        leads = found.leads
        for value, n in (("candidates", F.count("*")), ("clusters", F.count_distinct("group_id"))):
            tallies = tallies.unionByName(found.candidates.agg(F.lit("dedup").alias("step"), F.lit(value).alias("value"), n.alias("n")))
    write_table(leads, f"{out}/leads")
    return Seeded(spark.read.parquet(f"{out}/leads"), imported, tallies)
