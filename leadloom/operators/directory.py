"""The directory of leads: filters, search, pages, values, updates, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import phone, status
from ..schemas import EXPORT_COLUMNS, LEAD_RESPONSE, LEAD_UPDATABLE, REVIEWS

SEARCHED = ("full_name", "first_name", "last_name", "company_name", "email")
EXPORT_LIMIT = 10_000


def _contains(column: str, text: str) -> Column:
    """Case-insensitive; % and _ of the text are wildcards."""
    return F.col(column).ilike(f"%{text}%")


def filtered(leads: DataFrame, status_is: str | None = None, owner: str | None = None, country: str | None = None, q: str | None = None) -> DataFrame:
    """An unknown status asks for new leads, as it is normalised first."""
    out = leads
    if status_is:
        out = out.filter(F.col("lead_status") == status(F.lit(status_is)))
    if owner:
        out = out.filter(_contains("contact_owner", owner))
    if country:
        out = out.filter(_contains("country", country))
    if q:
        hit = _contains(SEARCHED[0], q)
        for column in SEARCHED[1:]:
            hit = hit | _contains(column, q)
        out = out.filter(hit)
    return out


def ordered(leads: DataFrame, sort_by: str = "created_at", sort_order: str = "desc") -> DataFrame:
    """By any column (created_at if unknown), nulls as the greatest; equal ones by id."""
    c = F.col(sort_by if sort_by in leads.columns else "created_at")
    return leads.orderBy(c.asc_nulls_last() if sort_order == "asc" else c.desc_nulls_first(), "id")


def page(leads: DataFrame, number: int = 1, size: int = 25, sort_by: str = "created_at", sort_order: str = "desc", **how) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages start at 1 and hold 1 to 100 leads")
    return ordered(filtered(leads, **how), sort_by, sort_order).offset((number - 1) * size).limit(size)


def totals(leads: DataFrame, size: int = 25, **how) -> DataFrame:
    """total and total_pages, one row."""
    n = F.count("*")
    return filtered(leads, **how).agg(n.alias("total"), F.ceil(n / size).alias("total_pages"))


def responses(leads: DataFrame) -> DataFrame:
    return leads.select(*[c for c in LEAD_RESPONSE if c in leads.columns])


def by_id(leads: DataFrame, lead_id: int) -> DataFrame:
    return leads.filter(F.col("id") == lead_id).limit(1)


def by_email(leads: DataFrame, email: str) -> DataFrame:
    return leads.filter(F.lower("email") == email.strip().lower()).orderBy("id").limit(1)


def by_phone(leads: DataFrame, number: str) -> DataFrame:
    return leads.filter(F.col("phone_normalized") == phone(F.lit(number)))


def distinct_values(leads: DataFrame, column: str) -> DataFrame:
    """value: distinct values but blank ones, in order; none for an unknown column."""
    if column not in leads.columns:
        return leads.sparkSession.createDataFrame([], "value string")
    value = F.col(column).cast("string").alias("value")
    return leads.select(value).filter(F.col("value") != "").distinct().orderBy("value")


def filter_values(leads: DataFrame) -> DataFrame:
    """One row of arrays: statuses, owners, countries, channels; one scan."""
    named = {"statuses": "lead_status", "owners": "contact_owner", "countries": "country", "channels": "ai_source_channel"}
    return leads.agg(*[F.array_sort(F.filter(F.collect_set(c), lambda v: v != "")).alias(k) for k, c in named.items()])


def export_rows(leads: DataFrame, limit: int = EXPORT_LIMIT, **how) -> DataFrame:
    """The newest leads with the columns of the CSV export."""
    return ordered(filtered(leads, **how)).limit(limit).select(*EXPORT_COLUMNS)


def patched(leads: DataFrame, patches: DataFrame) -> DataFrame:
    """``leads`` with the values of ``patches`` (id and any updatable columns); nulls change nothing.

    A status is normalised, a new phone number also renews its digits; the full
    name is not made anew.
    """
    names = [c for c in LEAD_UPDATABLE if c in patches.columns]
    p = patches.select(F.col("id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in names])
    out = leads.join(p, F.col("id") == F.col("p_id"), "left")
    new = {}
    for c in names:
        value = F.col(f"p_{c}")
        if c == "lead_status":
            value = F.when(value.isNotNull(), status(value))
        if c == "phone_number":
            new["phone_normalized"] = F.when(value.isNotNull(), phone(value)).otherwise(F.col("phone_normalized"))
        new[c] = F.coalesce(value, F.col(c))
    return out.withColumns(new).select(*leads.columns)


def patch_outcomes(leads: DataFrame, patches: DataFrame) -> DataFrame:
    """id, outcome of each patch: updated, empty (no updatable column has a value) or not_found; an empty one is told first."""
    names = [c for c in LEAD_UPDATABLE if c in patches.columns]
    given = F.coalesce(*[F.col(c).cast("string") for c in names]) if names else F.lit(None)
    known = leads.select(F.col("id").alias("__id"))
    out = patches.join(known, F.col("id") == F.col("__id"), "left")
    return out.select("id", F.when(given.isNull(), "empty").when(F.col("__id").isNull(), "not_found").otherwise("updated").alias("outcome"))


def review_outcomes(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """lead_id_1, lead_id_2, outcome of each review: updated, bad_status or not_found; a bad status is told first."""
    known = candidates.select(F.col("lead_id_1").alias("__1"), F.col("lead_id_2").alias("__2"))
    out = reviews.join(known, (F.col("lead_id_1") == F.col("__1")) & (F.col("lead_id_2") == F.col("__2")), "left")
    bad = ~F.coalesce(F.col("status").isin(*REVIEWS), F.lit(False))
    return out.select("lead_id_1", "lead_id_2", F.when(bad, "bad_status").when(F.col("__1").isNull(), "not_found").otherwise("updated").alias("outcome"))


def reviewed(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """``candidates`` with the status of ``reviews`` (lead_id_1, lead_id_2, status); unknown statuses change nothing."""
    r = reviews.filter(F.col("status").isin(*REVIEWS)).select(F.col("lead_id_1").alias("r1"), F.col("lead_id_2").alias("r2"), F.col("status").alias("r_status"))
    out = candidates.join(r, (F.col("lead_id_1") == F.col("r1")) & (F.col("lead_id_2") == F.col("r2")), "left")
    return out.withColumn("status", F.coalesce("r_status", "status")).drop("r1", "r2", "r_status")


def candidate_list(candidates: DataFrame, status_is: str | None = None, min_confidence: float | None = None) -> DataFrame:
    out = candidates
    if status_is:
        out = out.filter(F.col("status") == status_is)
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    return out.orderBy(F.desc("confidence"), "lead_id_1", "lead_id_2")


def candidates_with_leads(candidates: DataFrame, leads: DataFrame) -> DataFrame:
    """``candidates`` with both leads as structs ``lead_1`` and ``lead_2`` (null where there is none)."""
    lead = F.struct(*leads.columns)
    one, two = (leads.select(lead.alias(f"lead_{k}")) for k in (1, 2))
    out = candidates.join(one, F.col("lead_id_1") == F.col("lead_1.id"), "left")
    return out.join(two, F.col("lead_id_2") == F.col("lead_2.id"), "left")
