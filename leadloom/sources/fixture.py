"""A CRM export and form submissions derived from the star-schema tables.

The recipe is SQL that Spark and DuckDB read alike, so the oracles start from
the same rows and differ from the library in everything after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attribution import attribute_missing
from ..schemas import CRM_COLUMNS
from ..storage import modified, written
from .leads import crm_to_leads

FIRST = ["Anna", "Björn", "Chloé", "Dmitri", "Elena", "Farid", "Grace", "Hiro", "Ines", "Jean-Luc", "Karin", "Liam", "Mary Jane", "Noor", "Olga", "Pablo", "Quentin", "Rosa", "Sven", "Tara"]
LAST = ["Alvarez", "Andersson", "Anderson", "Becker", "Brandt", "Chen", "Colombo", "Diallo", "Diaz", "Dias", "Fischer", "Haddad", "Ivanov", "Jansen", "Jensen", "Kim", "Lopez", "Müller", "Muller", "Nakamura", "Okafor", "Petrov", "Singh"]
NOTES = [
    "Scanned our QR code at the TechWorld Expo booth.",
    "Spoke with them at our SaaS Summit booth, wants pricing.",
    "Met her at the booth during Cloud Week, follow up.",
    "Came through the book-a-demo page after clicking a Google ad.",
    "Googled us and landed on the pricing page before signing up.",
    "LinkedIn DM inbound, asked for a deck.",
    "Saw our post about AI workflows and commented on it.",
    "Referred by Maria Santos. Wants a call.",
    "Filled out the form on the contact page. Asked for docs.",
    "Manual — added after inbound phone call.",
    "On the cold outreach list of spring.",
    "Reached out via our general info@ inbox.",
    None,
    "  ",
    "Has a question nobody could place.",
    "Possible duplicate of an older record.",
]


def _pick(key: str, values: list[str | None]) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


_DIV = lambda n: f"CAST(floor(k / {n}) AS BIGINT)"
_TEXT = lambda x: f"CAST({x} AS STRING)"

#: CTEs: ``crm`` with id, v (variant), created_s (seconds) and the text columns of the export.
CRM_SQL = f"""
first_order AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey),
base AS (
  SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg, c_nationkey AS nk, n_name AS nation, d
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN first_order ON o_custkey = c_custkey
),
person AS (
  SELECT k, bal, seg, nk, nation, d, {_pick('k % 20', FIRST)} AS f, {_pick(_DIV(7) + ' % 23', LAST)} AS l,
    'comp' || {_TEXT(_DIV(3) + ' % 41')} AS comp, {_pick('k % 4', [' Ltd', ' GmbH', ' Holdings', ' Analytics Inc.'])} AS legal
  FROM base
),
variants AS (
  SELECT 0 AS v, k + 1 AS id, person.* FROM person
  UNION ALL SELECT 1 AS v, k + 1000001 AS id, person.* FROM person WHERE k % 5 = 0
  UNION ALL SELECT 2 AS v, k + 2000001 AS id, person.* FROM person WHERE k % 25 = 0
),
crm AS (
  SELECT id, v, 1767225600 + k * 3 + v AS created_s,
    CASE WHEN k % 17 = 0 THEN 'n/a' ELSE ' ' || {_TEXT('id')} || ' ' END AS record_id,
    CASE WHEN v = 1 THEN substring(f, 1, 1) || '.' WHEN k % 6 = 5 THEN NULL ELSE ' ' || f || ' ' END AS first_name,
    CASE WHEN k % 6 = 5 AND v <> 1 THEN '' ELSE l END AS last_name,
    CASE WHEN k % 6 = 5 AND v <> 1 THEN 'Dr. ' || f || ' ' || l WHEN k % 4 = 1 THEN f || ' ' || l ELSE NULL END AS full_name,
    CASE WHEN k % 3 = 0 THEN 'Head of ' || seg WHEN k % 3 = 1 THEN '  ' ELSE NULL END AS job_title,
    CASE WHEN k % 10 = 3 THEN ' ' WHEN v = 1 THEN comp || legal || ' & Co' ELSE comp || legal END AS company_name,
    CASE WHEN k % 97 = 96 THEN ' ' WHEN v = 2 THEN lower(replace(f, ' ', '')) || lower(l) || '@' || comp || '.example'
      ELSE ' ' || replace(f, ' ', '') || '.' || l || {_TEXT('k % 3')} || '@' || comp || '.example ' END AS email,
    CASE WHEN k % 20 = 7 THEN '+1 555-0100-000' WHEN k % 23 = 0 THEN NULL WHEN v = 1 THEN '1 (555) ' || lpad({_TEXT('k')}, 7, '0')
      WHEN v = 2 THEN '555' || lpad({_TEXT('k')}, 7, '0') WHEN k % 9 = 4 THEN '+1 555-' || lpad({_TEXT('k')}, 7, '0') || ' ext. 12' ELSE '+1 555-' || lpad({_TEXT('k')}, 7, '0') END AS phone_number,
    CASE WHEN nk = 23 THEN 'UK' WHEN nk = 4 THEN 'uae' WHEN nk = 24 THEN 'USA' WHEN k % 12 = 5 THEN '' WHEN k % 4 = 0 THEN ' ' || lower(nation) || ' ' ELSE nation END AS country,
    CASE seg WHEN 'AUTOMOBILE' THEN ' NEW ' WHEN 'BUILDING' THEN '"Qualified"' WHEN 'FURNITURE' THEN 'Closed Won' WHEN 'MACHINERY' THEN 'closedlost' ELSE CASE WHEN k % 2 = 0 THEN 'Contacted' ELSE 'strange' END END AS lead_status,
    {_pick('nk % 6', ['MQL', 'lead', ' Sales Qualified Lead ', 'Subscriber', '', 'Customer'])} AS lifecycle_stage,
    {_pick('k % 3', ['Direct', ' Paid ', ''])} AS original_source,
    CASE WHEN k % 8 = 0 THEN 'drill ' || {_TEXT('k % 8')} ELSE NULL END AS source_drill_down,
    CASE WHEN k % 13 = 0 THEN ' ' ELSE {_pick('k % 4', ['Ada Reed ', ' Ben Ortiz', 'Cleo Park', 'Dan Wu'])} END AS contact_owner,
    CASE WHEN k % 11 = 0 THEN 'n/a' ELSE {_TEXT('CAST(floor(bal / 100) AS BIGINT)')} END AS lead_score,
    {_pick('(k + v) % 16', NOTES)} AS notes,
    CASE WHEN d IS NULL THEN NULL WHEN k % 4 = 0 THEN {_TEXT('year(d)')} || '-' || lpad({_TEXT('month(d)')}, 2, '0') || '-' || lpad({_TEXT('day(d)')}, 2, '0')
      WHEN k % 4 = 1 THEN {_TEXT('month(d)')} || '/' || {_TEXT('day(d)')} || '/' || {_TEXT('year(d)')}
      WHEN k % 4 = 2 THEN {_TEXT('year(d)')} || '-' || lpad({_TEXT('month(d)')}, 2, '0') || '-' || lpad({_TEXT('day(d)')}, 2, '0') || 'T06:30:00Z' ELSE 'not-a-date' END AS create_date,
    CASE WHEN k % 5 = 0 THEN '27/05/2026' WHEN k % 5 = 1 THEN '2026-04-05T00:00:00+07:00' WHEN k % 5 = 2 THEN '2026-02-31' ELSE NULL END AS modified_date
  FROM variants
)"""

#: CTE: ``subs`` with pos and the columns of a submission; every other sender is a known lead.
SUBS_SQL = f"""
sender AS (
  SELECT event_id AS pos, user_id AS k, ts, {_pick('user_id % 20', FIRST)} AS f, {_pick('CAST(floor(user_id / 7) AS BIGINT) % 23', LAST)} AS l,
    'comp' || {_TEXT('CAST(floor(user_id / 3) AS BIGINT) % 41')} AS comp
  FROM events WHERE event_type = 'signup'
),
subs AS (
  SELECT pos, 'f' || {_TEXT('k % 5')} AS form_id, CASE WHEN k % 7 = 0 THEN NULL ELSE 'signup' END AS form_name, 'https://site.example/' || {_TEXT('k % 9')} AS page_url,
    CASE WHEN k % 6 = 0 THEN 'soon' ELSE {_TEXT('year(ts)')} || '-' || lpad({_TEXT('month(ts)')}, 2, '0') || '-' || lpad({_TEXT('day(ts)')}, 2, '0') END AS submitted_at,
    f || ' ' || l AS name,
    CASE WHEN k % 29 = 28 THEN ' ' WHEN k % 2 = 0 THEN replace(f, ' ', '') || '.' || l || {_TEXT('k % 3')} || '@' || comp || '.example' ELSE 'new' || {_TEXT('k')} || '.' || {_TEXT('pos')} || '@fresh' || {_TEXT('pos')} || '.example' END AS email,
    CASE WHEN k % 2 = 0 AND k % 23 <> 0 THEN '+1 555-' || lpad({_TEXT('k')}, 7, '0') WHEN k % 3 = 0 THEN '+44 ' || lpad({_TEXT('pos')}, 9, '0') ELSE NULL END AS phone,
    CASE WHEN k % 2 = 0 AND k % 10 <> 3 THEN comp ELSE NULL END AS company,
    CASE WHEN k % 3 = 0 THEN 'italy' ELSE NULL END AS country,
    {_pick('k % 16', NOTES)} AS message
  FROM sender
)"""


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _SOURCES}


def _sql(spark: SparkSession, sf_dir: str, ctes: str, tail: str) -> DataFrame:
    tables = _views(spark, sf_dir)
    names = {t: f"{{{t}}}" for t in tables if f" {t} " in f" {ctes} "}
    text = f"WITH {ctes} {tail}".replace("{", "{{").replace("}", "}}")
    for t in names:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **{t: tables[t] for t in names})


def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export with its own column names, id and created_at."""
    rows = _sql(spark, sf_dir, CRM_SQL, "SELECT * FROM crm")
    back = {snake: name for name, snake in CRM_COLUMNS.items()}
    return rows.select("id", F.timestamp_seconds("created_s").alias("created_at"), *[F.col(snake).alias(name) for snake, name in back.items()])


_SOURCES = ("customer", "nation", "orders", "events")
_tables: dict[tuple, DataFrame] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir, name, *[modified(spark, f"{sf_dir}/{t}.parquet") for t in _SOURCES])


def _table(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The table that ``make`` gives, written once for a session as an import would, and anew if its sources have changed; queries read it as they do any table."""
    key = _key(spark, sf_dir, name)
    if key not in _tables:
        _tables[key] = written(make())
    return _tables[key]


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of the export, read and normalised now."""
    return crm_to_leads(crm(spark, sf_dir))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of imported leads, without sources."""
    return _table(spark, sf_dir, "leads", lambda: imported(spark, sf_dir))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of imported leads with sources; that of leads without is not made for it, but read where there is one."""
    def make() -> DataFrame:
        known = _tables.get(_key(spark, sf_dir, "leads"))
        return attribute_missing(imported(spark, sf_dir) if known is None else known)

    return _table(spark, sf_dir, "attributed", make)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form submissions with pos, their order."""
    return _sql(spark, sf_dir, SUBS_SQL, "SELECT * FROM subs")
