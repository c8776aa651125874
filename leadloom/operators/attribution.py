"""Source attribution: an ordered table of patterns, the first that fits wins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import strip
from .model import Model, sources


class Rule(NamedTuple):
    pattern: str
    channel: str
    detail: str | None  # {0}: the first group; None: the landing page
    any_case: bool = True


# The patterns with their channels and details, in order of precedence.
RULES = [
    Rule(r"(?:scanned|scan)\s+(?:the\s+)?(?:our\s+)?QR\s+code\s+at\s+(?:the\s+|our\s+)?(.+?)(?:\s+booth)", "Event", "{0} — Booth QR Code"),
    Rule(r"(?:He|She|They)?\s*scanned\s+(?:our\s+)?QR\s+code\s+at\s+(?:the\s+|our\s+)?(.+?)(?:\s+booth)", "Event", "{0} — Booth QR Code"),
    Rule(r"Scanned\s+the\s+QR\s+code\s+at\s+our\s+(.+?)\s+booth", "Event", "{0} — Booth QR Code"),
    Rule(r"(?:Met|Spoke)\s+(?:her|him|them|with\s+them)?\s*at\s+(?:the|our)\s+booth\s+during\s+(.+?)(?:,|\.|$)", "Event", "{0} — Booth Visit"),
    Rule(r"(?:Met|Spoke)\s+(?:her|him|them|with\s+them)?\s*at\s+(?:the\s+|our\s+)?(.+?)\s+booth", "Event", "{0} — Booth Visit"),
    Rule(r"booth\s+during\s+(.+?)(?:,|\.|$)", "Event", "{0} — Booth Visit"),
    Rule(r"at\s+our\s+(.+?)\s+booth", "Event", "{0} — Booth Visit"),
    Rule(r"(?:clicking|clicked)\s+a?\s*google\s+ad", "Website", "Paid Search — Google Ads"),
    Rule(r"book-?a-?demo\s+page\s+after\s+clicking\s+a?\s*(?:google\s+)?ad", "Website", "Paid Search — Google Ads → Book a Demo"),
    Rule(r"(?:Googled\s+us|organic\s+google\s+search|found\s+us\s+through\s+organic)", "Organic Search", None),
    Rule(r"[Ll]inkedin\s+dm\s+inbound", "LinkedIn", "LinkedIn DM Inbound"),
    Rule(r"[Cc]onnected\s+on\s+[Ll]inked[Ii]n\s+after\s+commenting", "LinkedIn", "LinkedIn Post Comment"),
    Rule(r"[Ss]aw\s+our\s+post\s+about\s+(.+?)(?:\s+and\s+commented|\.\s|$)", "LinkedIn", "LinkedIn — Post about {0}"),
    Rule(r"[Rr]eferred\s+by\s+([A-Z][a-zA-Z'’-]+(?:\s+[A-Z][a-zA-Z'’-]+)*)", "Referral", "Referred by {0}", False),
    Rule(r"[Ff]illed\s+out\s+the\s+form\s+on\s+(?:the\s+)?(.+?)(?:\.\s|\.?$)", "Website", "Form Submission — {0}", False),
    Rule(r"book-?a-?demo\s+page", "Website", "Book a Demo Page"),
    Rule(r"Booked\s+a\s+demo\s+via\s+the\s+(.+?)(?:\s+after|\.\s|$)", "Website", "Demo Booking via {0}"),
    Rule(r"[Mm]anually\s+added\s+by\s+sales", "Manual/Sales", "Manually Added by Sales"),
    Rule(r"[Mm]anual\s*[-–—]\s*added\s+after\s+inbound\s+phone\s+call", "Manual/Sales", "Inbound Phone Call"),
    Rule(r"cold\s+outreach\s+list", "Manual/Sales", "Cold Outreach List"),
    Rule(r"walked\s+into\s+our\s+office", "Manual/Sales", "Walk-in"),
    Rule(r"reached\s+out\s+via\s+our\s+general\s+info@?\s*inbox", "Manual/Sales", "Inbound Email (info@ inbox)"),
    Rule(r"Other\s*[-–—]\s*reached\s+out\s+via\s+our\s+general\s+info", "Manual/Sales", "Inbound Email (info@ inbox)"),
    Rule(r"Other\s*[-–—]\s*walked\s+into\s+our\s+office", "Manual/Sales", "Walk-in"),
    Rule(r"inbound\s+phone\s+call", "Manual/Sales", "Inbound Phone Call"),
]
LANDING_PAGE = r"(?:landed\s+on|ended\s+up\s+on)\s+(?:the\s+)?(.+?)(?:\.|\s+(?:before|page|then)|$)"

NO_NOTES = "No notes available"
NO_SOURCE = "Could not determine source"
NO_RULE = "Rule-based extraction did not match"


def _java(rule: Rule) -> str:
    # Unicode classes and case, only \n ends a line; the dot matches all in the patterns that mind case
    return ("(?iuUd)" if rule.any_case else "(?sUd)") + rule.pattern


def _group(notes: Column, pattern: str) -> Column:
    return F.regexp_replace(strip(F.regexp_extract(notes, pattern, 1)), "[.,]+$", "")


def by_rules(notes: Column) -> Column:
    """struct<channel, detail> of the first rule that fits, else null."""
    return F.get(F.transform(F.array(notes), _first_rule), F.lit(0))


def _first_rule(notes: Column) -> Column:
    landing = "(?iuUd)" + LANDING_PAGE
    out = None
    for rule in RULES:
        java = _java(rule)
        if rule.detail is None:
            page = F.when(notes.rlike(landing), _group(notes, landing)).otherwise("Unknown page")
            detail = F.concat(F.lit("Organic Search → "), page)
        elif "{0}" in rule.detail:
            before, after = rule.detail.split("{0}")
            detail = F.concat(F.lit(before), _group(notes, java), F.lit(after))
        else:
            detail = F.lit(rule.detail)
        value = F.struct(F.lit(rule.channel).alias("channel"), detail.alias("detail"))
        out = F.when(notes.rlike(java), value) if out is None else out.when(notes.rlike(java), value)
    return F.when(notes != "", out)


def _other(text: str) -> Column:
    return F.struct(F.lit("Other").alias("channel"), F.lit(text).alias("detail"))


def source(notes: Column) -> Column:
    """struct<channel, detail>; never null. Without a model, what no rule fits is Other."""
    return F.when(F.coalesce(notes, F.lit("")) == "", _other(NO_NOTES)).otherwise(F.coalesce(by_rules(notes), _other(NO_SOURCE)))


def extracted(rows: DataFrame, model: Model | None = None, notes: str = "notes") -> DataFrame:
    """``rows`` with channel and detail: by rules, else by ``model``, which is asked once for each text that no rule fits, else Other."""
    out = rows.withColumn("__rule", by_rules(F.col(notes)))
    blank = F.coalesce(F.col(notes), F.lit("")) == ""
    told = F.lit(None).cast("struct<channel:string,detail:string>")
    if model is not None:
        left = sources(model, out.filter(~blank & F.col("__rule").isNull()).select(F.col(notes).alias("notes")))
        out = out.join(left.select(F.col("notes").alias("__n"), F.struct("channel", "detail").alias("__told")), F.col("__rule").isNull() & (F.col(notes) == F.col("__n")), "left").drop("__n")
        told = F.col("__told")
    out = out.withColumn("__s", F.when(blank, _other(NO_NOTES)).otherwise(F.coalesce("__rule", told, _other(NO_SOURCE))))
    return out.withColumns({"channel": F.col("__s.channel"), "detail": F.col("__s.detail")}).drop("__rule", "__told", "__s")


def attribute_missing(leads: DataFrame) -> DataFrame:
    """``leads`` with channel and detail filled by rules where the channel is null."""
    blank = F.coalesce("notes", F.lit("")) == ""
    found = F.when(blank, _other(NO_NOTES)).otherwise(F.coalesce(by_rules(F.col("notes")), _other(NO_RULE)))
    out = leads.withColumn("__s", F.when(F.col("ai_source_channel").isNull(), found))
    out = out.withColumns({
        "ai_source_channel": F.coalesce("ai_source_channel", "__s.channel"),
        "ai_source_detail": F.when(F.col("__s").isNotNull(), F.col("__s.detail")).otherwise(F.col("ai_source_detail")),
    })
    return out.drop("__s")


def extraction_outcomes(leads: DataFrame, requests: DataFrame, model: Model | None = None) -> DataFrame:
    """outcome of each request (lead_id, notes, save_to_lead) with channel, detail and saved.

    ok; not_found (a lead that is asked for and isn't there); no_notes (neither
    the request nor its lead has any). ``saved`` says whether ``save_source``
    has to write it, which a dry run has not.
    """
    known = leads.select(F.col("id").alias("__id"), F.col("notes").alias("__notes"))
    r = requests.join(known, F.col("lead_id") == F.col("__id"), "left")
    r = r.withColumn("__text", F.coalesce(F.nullif("notes", F.lit("")), "__notes"))
    missing = F.col("lead_id").isNotNull() & F.col("__id").isNull()
    outcome = F.when(missing, "not_found").when(F.coalesce(strip(F.col("__text")), F.lit("")) == "", "no_notes").otherwise("ok")
    r = extracted(r.withColumn("outcome", outcome), model, "__text")
    fine = F.col("outcome") == "ok"
    saved = fine & F.col("lead_id").isNotNull() & F.coalesce("save_to_lead", F.lit(False))
    return r.select(*requests.columns, "outcome", F.when(fine, F.col("channel")).alias("channel"), F.when(fine, F.col("detail")).alias("detail"), saved.alias("saved"))


def save_source(leads: DataFrame, requests: DataFrame) -> DataFrame:
    """``leads`` with the source of requested ones: explicit notes go before stored ones; blank ones are left as they are.

    ``requests``: lead_id, notes.
    """
    r = requests.select(F.col("lead_id").alias("__id"), F.nullif(F.col("notes"), F.lit("")).alias("__notes"))
    out = leads.join(r, F.col("id") == F.col("__id"), "left")
    notes = F.coalesce("__notes", "notes")
    out = out.withColumn("__s", F.when(F.col("__id").isNotNull() & (F.coalesce(strip(notes), F.lit("")) != ""), source(notes)))
    return out.withColumns({
        "ai_source_channel": F.coalesce("__s.channel", "ai_source_channel"),
        "ai_source_detail": F.coalesce("__s.detail", "ai_source_detail"),
    }).drop("__id", "__notes", "__s")
