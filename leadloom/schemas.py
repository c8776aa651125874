"""Schemas and enumerations of leads, candidates and submissions."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Columns of the tables and of the files that are exchanged, in their order.
LEAD = _struct(
    id=L, record_id=L, first_name=S, last_name=S, full_name=S, job_title=S, company_name=S, email=S, phone_number=S,
    phone_normalized=S, country=S, lead_status=S, lifecycle_stage=S, original_source=S, source_drill_down=S,
    contact_owner=S, lead_score=I, notes=S, ai_source_channel=S, ai_source_detail=S, dedup_group_id=S,
    original_create_date=TS, original_modified_date=TS, created_at=TS, updated_at=TS,
)
#: What a lead is answered with: all columns but the normalised phone.
LEAD_RESPONSE = [f.name for f in LEAD if f.name != "phone_normalized"]
#: Columns a partial update may name.
LEAD_UPDATABLE = ["lead_status", "contact_owner", "notes", "job_title", "first_name", "last_name", "company_name", "phone_number", "country"]
SIGNALS = ("email", "phone", "name", "company", "notes_hint")
CANDIDATE = T.StructType([
    T.StructField("lead_id_1", L), T.StructField("lead_id_2", L), T.StructField("confidence", D),
    T.StructField("match_reasons", _struct(**{s: D for s in SIGNALS})),
    T.StructField("explanation", S), T.StructField("status", S), T.StructField("group_id", S),
])
SUBMISSION = _struct(form_id=S, form_name=S, page_url=S, submitted_at=S, name=S, email=S, phone=S, company=S, country=S, message=S)
FORM_LOG = _struct(form_id=S, form_name=S, page_url=S, submitted_at=TS, raw_payload=S, lead_id=L)

#: Columns of the CRM export, all read as text.
CRM_COLUMNS = {
    "Record ID": "record_id", "First Name": "first_name", "Last Name": "last_name", "Full Name": "full_name",
    "Job Title": "job_title", "Company Name": "company_name", "Email": "email", "Phone Number": "phone_number",
    "Country/Region": "country", "Lead Status": "lead_status", "Lifecycle Stage": "lifecycle_stage",
    "Original Source": "original_source", "Original Source Drill-Down 1": "source_drill_down",
    "Contact Owner": "contact_owner", "Lead Score": "lead_score", "Notes": "notes", "Create Date": "create_date",
    "Last Modified Date": "modified_date",
}
CRM = T.StructType([T.StructField(c, S) for c in CRM_COLUMNS])
#: Columns of the CSV export, in order.
EXPORT_COLUMNS = [
    "id", "record_id", "first_name", "last_name", "full_name", "job_title", "company_name", "email", "phone_number",
    "country", "lead_status", "lifecycle_stage", "original_source", "contact_owner", "lead_score", "notes",
    "ai_source_channel", "ai_source_detail", "original_create_date", "original_modified_date",
]

STATUSES = ("new", "qualified", "connected", "contacted", "opportunity", "closed_won", "closed_lost")
CHANNELS = ("Website", "Event", "LinkedIn", "Organic Search", "Referral", "Manual/Sales", "Other")
REVIEWS = ("pending", "confirmed", "rejected")
