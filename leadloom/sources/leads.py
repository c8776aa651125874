"""Readers and writers: CRM export, submissions, tables, and the CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..schemas import CRM, CRM_COLUMNS, EXPORT_COLUMNS, SUBMISSION


def read_crm_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text; UTF-8 with or without a byte order mark, quoted cells over several lines.

    Columns are found by the names in the header, so their order is free; a
    missing file raises. With ``multi_line`` a file is read by one task (many
    files by many); a large file whose cells have no line breaks is split
    without it.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    named = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{named[f.name]}`") if f.name in named else F.lit(None)).cast("string").alias(f.name) for f in CRM])


def crm_to_leads(rows: DataFrame, first_id: Column | None = None) -> DataFrame:
    """Leads of a CRM export; rows without an email are dropped, unreadable numbers and dates become null."""
    raw = {snake: F.col(f"`{name}`") for name, snake in CRM_COLUMNS.items()}
    who = N.name(raw["first_name"], raw["last_name"], raw["full_name"])
    out = rows.withColumn("__who", who).filter(N.email(raw["email"]).isNotNull())
    columns = {
        "record_id": N.whole_number(raw["record_id"], "bigint"),
        "first_name": F.col("__who.first"),
        "last_name": F.col("__who.last"),
        "full_name": F.col("__who.full"),
        "job_title": N.blank_to_null(raw["job_title"]),
        "company_name": F.coalesce(N.blank_to_null(raw["company_name"]), F.lit("Unknown")),
        "email": N.email(raw["email"]),
        "phone_number": N.blank_to_null(raw["phone_number"]),
        "phone_normalized": N.phone(raw["phone_number"]),
        "country": N.country(raw["country"]),
        "lead_status": N.status(raw["lead_status"]),
        "lifecycle_stage": N.lifecycle(raw["lifecycle_stage"]),
        "original_source": N.blank_to_null(raw["original_source"]),
        "source_drill_down": N.blank_to_null(raw["source_drill_down"]),
        "contact_owner": N.owner(raw["contact_owner"]),
        "lead_score": N.whole_number(raw["lead_score"], "int"),
        "notes": N.blank_to_null(raw["notes"]),
        "ai_source_channel": F.lit(None).cast("string"),
        "ai_source_detail": F.lit(None).cast("string"),
        "dedup_group_id": F.lit(None).cast("string"),
        "original_create_date": N.date(raw["create_date"]),
        "original_modified_date": N.date(raw["modified_date"]),
    }
    number = first_id if first_id is not None else (F.col("id") if "id" in rows.columns else F.monotonically_increasing_id() + 1)
    created = F.col("created_at") if "created_at" in rows.columns else F.current_timestamp()
    return out.select(number.cast("long").alias("id"), *[v.alias(k) for k, v in columns.items()], created.alias("created_at"), created.alias("updated_at"))


def import_counts(rows: DataFrame) -> DataFrame:
    """accepted and dropped rows of a CRM export, one row."""
    fine = N.email(F.col("Email")).isNotNull()
    return rows.agg(F.count_if(fine).alias("accepted"), F.count_if(~fine).alias("dropped"))


def rejected(rows: DataFrame) -> DataFrame:
    """Rows of a CRM export that make no lead, with the reason."""
    return rows.filter(N.email(F.col("Email")).isNull()).withColumn("reason", F.lit("no email"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Form submissions, one JSON object each."""
    return spark.read.schema(SUBMISSION).json(path)


def submissions_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """Form submissions of a text column that holds a JSON object each; null fields where it doesn't."""
    return texts.select(F.from_json(column, SUBMISSION).alias("s")).select("s.*")


def write_csv(leads: DataFrame, path: str) -> None:
    """The columns of the export with a header; times as ``yyyy-MM-dd HH:mm:ss`` with the offset, nulls empty; no leads give an empty text."""
    if leads.isEmpty():
        leads.sparkSession.createDataFrame([("",)], "value string").filter("value <> ''").coalesce(1).write.mode("overwrite").text(path)
        return
    times = [f.name for f in leads.schema if f.dataType.typeName().startswith("timestamp") and f.name in EXPORT_COLUMNS]
    rows = leads.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ssxxx").alias(c) if c in times else F.col(c) for c in EXPORT_COLUMNS])
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """A snapshot of a table (or rows added to a log)."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 16, **options: str) -> DataFrame:
    """A database table; in ``parts`` ranges of a numeric ``column`` where one is given. Needs the driver's jar."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def create_tables(spark: SparkSession, database: str) -> None:
    """Empty tables of the data model."""
    from ..schemas import CANDIDATE, FORM_LOG, LEAD

    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in (("leads", LEAD), ("dedupe_candidates", CANDIDATE), ("form_submissions", FORM_LOG)):
        spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(f"{database}.{name}")


def drop_tables(spark: SparkSession, database: str) -> None:
    for name in ("form_submissions", "dedupe_candidates", "leads"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
