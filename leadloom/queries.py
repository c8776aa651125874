"""The library's queries over the derived leads, one callable (spark, sf_dir) each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as N
from .functions.similarity import jaro_winkler
from .operators import attribution, blocking, components, dashboard, directory, ingest, model, scoring
from .plans import dedupe
from .schemas import SIGNALS
from .sources import fixture
from .sources import leads as source_leads

AS_OF = "2026-01-31 00:00:00"
AS_OF_ORDERS = "1998-08-02 00:00:00"


def _text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _plain(leads: DataFrame) -> DataFrame:
    """Times as text, whatever the session's zone means elsewhere."""
    times = [f.name for f in leads.schema if f.dataType.typeName() == "timestamp"]
    return leads.select(*[_text(c) if c in times else F.col(c) for c in leads.columns])


LEADS = (
    "id", "record_id", "first_name", "last_name", "full_name", "job_title", "company_name", "email", "phone_number", "phone_normalized", "country",
    "lead_status", "lifecycle_stage", "original_source", "source_drill_down", "contact_owner", "lead_score", "notes", "original_create_date",
    "original_modified_date",
)
SHORT = ("id", "full_name", "company_name", "email", "contact_owner", "country", "lead_status")


def leads_import_normalized(spark, d):
    return _plain(fixture.imported(spark, d)).select(*LEADS)


def _norm(column: str, use: Callable[[Column], Column]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fixture.crm(spark, d).select("id", F.col(f"`{column}`").alias("raw"), use(F.col(f"`{column}`")).alias("value"))

    return run


def norm_name(spark, d):
    who = N.name(F.col("`First Name`"), F.col("`Last Name`"), F.col("`Full Name`"))
    return fixture.crm(spark, d).select("id", who.alias("w")).select("id", "w.first", "w.last", "w.full")


def norm_date(spark, d):
    rows = fixture.crm(spark, d)
    return _plain(rows.select("id", N.date(F.col("`Create Date`")).alias("created"), N.date(F.col("`Last Modified Date`")).alias("modified")))


def lead_list_page(spark, d):
    return directory.page(fixture.attributed(spark, d), 2, 25, "lead_score", "desc").select(*SHORT, "lead_score")


def lead_search_q(spark, d):
    return directory.filtered(fixture.leads(spark, d), q="müller").select(*SHORT)


def lead_filter_status(spark, d):
    return directory.filtered(fixture.leads(spark, d), status_is=" Closed Won").select(*SHORT)


def lead_filter_owner(spark, d):
    return directory.filtered(fixture.leads(spark, d), owner="BEN o").select(*SHORT)


def lead_filter_country(spark, d):
    return directory.filtered(fixture.leads(spark, d), country="u_a").select(*SHORT)


def lead_filter_all(spark, d):
    return directory.filtered(fixture.leads(spark, d), status_is="new", owner="a", country="a", q="comp").select(*SHORT)


def lead_responses(spark, d):
    """What leads are answered with."""
    return _plain(directory.responses(fixture.attributed(spark, d)))


def import_counts(spark, d):
    return source_leads.import_counts(fixture.crm(spark, d))


def import_rejected(spark, d):
    return source_leads.rejected(fixture.crm(spark, d)).select("id", "reason")


def lead_totals(spark, d):
    return directory.totals(fixture.leads(spark, d), 25, q="comp1")


def lead_by_id(spark, d):
    return directory.by_id(fixture.leads(spark, d), 17).select(*SHORT)


def lead_by_email(spark, d):
    return directory.by_email(fixture.leads(spark, d), " ANNA.ALVAREZ0@comp0.example ").select(*SHORT)


def lead_by_phone(spark, d):
    return directory.by_phone(fixture.leads(spark, d), "+1 (555) 0100-000 ext 3").select(*SHORT)


def filter_values(spark, d):
    one = directory.filter_values(fixture.attributed(spark, d))
    return one.select(*[F.array_join(c, "|").alias(c) for c in one.columns])


def distinct_owners(spark, d):
    return directory.distinct_values(fixture.leads(spark, d), "contact_owner")


def export_rows(spark, d):
    return _plain(directory.export_rows(fixture.attributed(spark, d)))


def _counts(column: str):
    return lambda spark, d: dashboard.counts_by(fixture.attributed(spark, d), column)


def dashboard_totals(spark, d):
    return dashboard.totals(fixture.leads(spark, d), F.lit(AS_OF_ORDERS).cast("timestamp"))


def dashboard_all(spark, d):
    return dashboard.all_counts(fixture.attributed(spark, d))


def dashboard_row(spark, d):
    """The whole dashboard in one row."""
    one = dashboard.dashboard(fixture.attributed(spark, d), F.lit(AS_OF_ORDERS).cast("timestamp"))
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return one.select("total", "recent", *[told(f"by_{a}").alias(f"by_{a}") for a in dashboard.AXES])


class Parrot:
    """A model that makes its replies of the prompt, for the queries below."""

    def reply(self, prompts: DataFrame) -> DataFrame:
        p = F.col("prompt")
        names = F.regexp_extract_all(p, F.lit("- Name: (.*)"), F.lit(1))
        pair = F.to_json(F.struct(F.lit(True).alias("is_duplicate"), F.lit(0.9).alias("confidence"), F.array_join(names, " / ").alias("explanation")))
        said = (
            F.when(p.contains("- Name: "), F.concat(F.lit("```json\n"), pair, F.lit("\n```")))
            .when(p.contains("nobody could place"), '```json\n{"channel": "Event", "detail": "asked around"}\n```')
            .when(p.contains("older record"), '{"channel": "Rumour"}')
            .otherwise("no idea")
        )
        return prompts.select("key", said.alias("reply"))


def source_model(spark, d):
    """Sources by rules, and by a model where no rule fits."""
    return attribution.extracted(fixture.leads(spark, d).select("id", "notes"), Parrot()).select("id", "channel", "detail")


def reply_json(spark, d):
    """Replies with and without code fences, parsed."""
    n = F.col("id") % 4
    body = F.concat(F.lit('{"channel": "Event", "n": '), F.col("id").cast("string"), F.lit("}"))
    raw = F.when(n == 0, F.concat(F.lit(" ```json\n"), body, F.lit("\n``` "))).when(n == 1, F.concat(F.lit("```"), body, F.lit("```"))).when(n == 2, body).otherwise("none")
    parsed = fixture.leads(spark, d).select("id", N.fenced_json(raw, "channel string, n bigint").alias("j"))
    return parsed.select("id", "j.channel", "j.n")


def source_rules(spark, d):
    rows = fixture.leads(spark, d).select("id", attribution.source(F.col("notes")).alias("s"))
    return rows.select("id", "s.channel", "s.detail")


def attribute_missing(spark, d):
    return attribution.attribute_missing(fixture.leads(spark, d)).select("id", "ai_source_channel", "ai_source_detail")


def source_channel_counts(spark, d):
    rows = fixture.attributed(spark, d)
    ruled = ~F.col("ai_source_detail").isin(attribution.NO_NOTES, attribution.NO_RULE)
    return rows.groupBy("ai_source_channel").agg(F.count("*").alias("n"), F.count_if(ruled).alias("n_by_rule"))


def blocking_keys(spark, d):
    return blocking.keys(fixture.leads(spark, d))


def block_sizes(spark, d):
    return blocking.bucket_sizes(blocking.keys(fixture.leads(spark, d)))


def candidate_pairs(spark, d):
    return blocking.candidate_pairs(fixture.leads(spark, d))


def jaro_winkler_names(spark, d):
    leads = fixture.leads(spark, d)
    names = scoring.features(leads).select("id", F.col("f.name").alias("n"))
    pairs = blocking.candidate_pairs(leads)
    both = pairs.join(names.select(F.col("id").alias("lead_id_1"), F.col("n").alias("s")), "lead_id_1").join(names.select(F.col("id").alias("lead_id_2"), F.col("n").alias("t")), "lead_id_2")
    distinct = both.select("s", "t").distinct()
    return distinct.select("s", "t", F.round(jaro_winkler(F.col("s"), F.col("t")), 9).alias("similarity"))


def _scored(spark, d, at_least=None):
    leads = fixture.leads(spark, d)
    return scoring.scored(blocking.candidate_pairs(leads), leads, leads, at_least=at_least)


def score_pairs(spark, d):
    return _scored(spark, d).select("lead_id_1", "lead_id_2", *[F.round(s, 6).alias(s) for s in SIGNALS], F.round("confidence", 6).alias("confidence"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select(*[c for c in found.columns if c != "match_reasons"], *[F.col(f"match_reasons.{s}").alias(f"reason_{s}") for s in SIGNALS])


def dedupe_candidates(spark, d):
    return _flat(dedupe.find_candidates(fixture.leads(spark, d)))


def candidate_filter(spark, d):
    found = dedupe.find_candidates(fixture.leads(spark, d)).withColumn("status", F.lit("pending"))
    return directory.candidate_list(found, "pending", 0.8).select("lead_id_1", "lead_id_2", "confidence")


def candidate_with_leads(spark, d):
    leads = fixture.leads(spark, d)
    out = directory.candidates_with_leads(dedupe.find_candidates(leads).select("lead_id_1", "lead_id_2", "confidence"), leads)
    return out.select("lead_id_1", "lead_id_2", "confidence", F.col("lead_1.email").alias("email_1"), F.col("lead_2.email").alias("email_2"))


def llm_shortlist(spark, d):
    return dedupe.shortlist(dedupe.find_candidates(fixture.leads(spark, d))).select("lead_id_1", "lead_id_2", "confidence")


def llm_remarks(spark, d):
    leads = fixture.leads(spark, d)
    return dedupe.remarked(dedupe.find_candidates(leads), leads, model.ModelVerifier(Parrot())).select("lead_id_1", "lead_id_2", "explanation")


def remark_cache(spark, d):
    """Remarks of an earlier run are used again; only other pairs are asked about."""
    leads = fixture.leads(spark, d)
    found = dedupe.find_candidates(leads)
    earlier = found.filter("lead_id_1 % 2 = 0").withColumn("explanation", F.concat("explanation", F.lit(dedupe.REMARK), F.lit("seen before")))
    return dedupe.remarked(found, leads, model.ModelVerifier(Parrot()), earlier).select("lead_id_1", "lead_id_2", "explanation")


def cluster_leads(spark, d):
    leads = fixture.leads(spark, d)
    out = components.clusters_with_leads(components.clustered(dedupe.find_candidates(leads)), leads)
    return out.select("group_id", "confidence", F.array_join(F.transform("leads", lambda x: x["email"]), ",").alias("emails"))


def dedupe_components(spark, d):
    return components.components(dedupe.find_candidates(fixture.leads(spark, d)))


def dedupe_clusters(spark, d):
    out = components.clusters(components.clustered(dedupe.find_candidates(fixture.leads(spark, d))))
    return out.withColumn("lead_ids", F.array_join(F.col("lead_ids").cast("array<string>"), ","))


def leads_with_group(spark, d):
    leads = fixture.leads(spark, d)
    return components.with_group(leads, components.clustered(dedupe.find_candidates(leads))).select("id", "dedup_group_id")


def review_update(spark, d):
    found = dedupe.find_candidates(fixture.leads(spark, d)).withColumn("status", F.lit("pending")).select("lead_id_1", "lead_id_2", "confidence", "status")
    said = F.when(F.col("lead_id_1") % 3 == 0, "confirmed").when(F.col("lead_id_1") % 3 == 1, "rejected").otherwise("maybe")
    return directory.reviewed(found, found.select("lead_id_1", "lead_id_2", said.alias("status")))


def review_outcomes(spark, d):
    found = dedupe.find_candidates(fixture.leads(spark, d)).select("lead_id_1", "lead_id_2")
    said = F.when(F.col("lead_id_1") % 3 == 0, "confirmed").when(F.col("lead_id_1") % 3 == 1, "maybe").otherwise("pending")
    reviews = found.unionByName(found.withColumn("lead_id_2", F.col("lead_id_2") + 10_000_000)).withColumn("status", said)
    return directory.review_outcomes(found, reviews)


def patch_outcomes(spark, d):
    leads = fixture.leads(spark, d)
    ids = leads.select("id").unionByName(leads.select((F.col("id") + 10_000_000).alias("id")))
    patches = ids.select("id", F.when(F.col("id") % 3 == 0, "new").alias("lead_status"), F.when(F.col("id") % 5 == 0, "note").alias("notes"))
    return directory.patch_outcomes(leads, patches)


def extraction_outcomes(spark, d):
    leads = fixture.leads(spark, d)
    ids = leads.select("id").unionByName(leads.select((F.col("id") + 10_000_000).alias("id")))
    asked = ids.select(F.col("id").alias("lead_id"), F.when(F.col("id") % 5 == 0, "Walked into our office").when(F.col("id") % 5 == 1, " ").alias("notes"), (F.col("id") % 2 == 0).alias("save_to_lead"))
    return attribution.extraction_outcomes(leads, asked).select("lead_id", "outcome", "channel", "detail", "saved")


def patch_leads(spark, d):
    leads = fixture.leads(spark, d)
    third = F.col("id") % 3 == 0
    patches = leads.filter("id % 2 = 0").select(
        "id",
        F.when(third, " Qualified ").alias("lead_status"),
        F.when(~third, F.concat(F.lit("+44 20 "), F.lpad(F.col("id").cast("string"), 8, "0"))).alias("phone_number"),
        F.when(third, F.lit("Zoë Reed")).alias("contact_owner"),
    )
    return directory.patched(leads, patches).select("id", "lead_status", "phone_number", "phone_normalized", "contact_owner", "full_name")


def save_extraction(spark, d):
    leads = fixture.leads(spark, d)
    asked = leads.filter("id % 2 = 1").select(F.col("id").alias("lead_id"), F.when(F.col("id") % 5 == 0, "Walked into our office").alias("notes"))
    return attribution.save_source(leads, asked).select("id", "ai_source_channel", "ai_source_detail")


def best_match(spark, d):
    probes = ingest.transient(fixture.submissions(spark, d)).filter("email IS NOT NULL")
    out = ingest.best_matches(probes, fixture.leads(spark, d))
    return out.withColumn("confidence", F.round("confidence", 6))


def _ingested(spark, d):
    return ingest.ingest(fixture.submissions(spark, d), fixture.attributed(spark, d), F.lit(AS_OF).cast("timestamp"))


def ingest_result(spark, d):
    return _ingested(spark, d).details


def ingest_totals(spark, d):
    return ingest.totals(_ingested(spark, d).details)


def ingest_leads_after(spark, d):
    return _plain(_ingested(spark, d).leads).select("id", "email", "phone_normalized", "country", "notes", "ai_source_channel", "original_create_date")


def ingest_audit(spark, d):
    return _plain(_ingested(spark, d).log)


def resolve_leads(spark, d):
    """The whole resolution: clusters of the fixture's leads."""
    found = dedupe.resolve(fixture.leads(spark, d)).candidates
    return components.clusters(found).withColumn("lead_ids", F.array_join(F.col("lead_ids").cast("array<string>"), ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        leads_import_normalized, norm_name, norm_date, lead_list_page, lead_search_q, lead_filter_status, lead_filter_owner, lead_filter_country, lead_filter_all, lead_responses, import_counts, import_rejected, lead_totals, lead_by_id, lead_by_email,
        lead_by_phone, filter_values, distinct_owners, export_rows, dashboard_totals, dashboard_all, dashboard_row, source_rules, source_model, reply_json, attribute_missing,
        source_channel_counts, blocking_keys, block_sizes, candidate_pairs, jaro_winkler_names, score_pairs, dedupe_candidates, candidate_filter,
        candidate_with_leads, llm_shortlist, llm_remarks, remark_cache, dedupe_components, dedupe_clusters, cluster_leads, leads_with_group, review_update, review_outcomes,
        patch_leads, patch_outcomes, save_extraction, extraction_outcomes,
        best_match, ingest_result, ingest_totals, ingest_leads_after, ingest_audit, resolve_leads,
    ]
    out = {f.__name__: f for f in own}
    out |= {
        "norm_status": _norm("Lead Status", N.status),
        "norm_phone": _norm("Phone Number", N.phone),
        "norm_country": _norm("Country/Region", N.country),
        "norm_company": _norm("Company Name", N.company),
        "norm_lifecycle": _norm("Lifecycle Stage", N.lifecycle),
        "norm_email": _norm("Email", N.email),
        "norm_owner": _norm("Contact Owner", N.owner),
    }
    return out | {f"dashboard_by_{axis}": _counts(column) for axis, column in dashboard.AXES.items()}
