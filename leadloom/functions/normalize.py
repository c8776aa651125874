"""Normalisers of lead fields, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STATUSES

# Spellings, aliases and word lists.
STATUS_ALIASES = {"closed won": "closed_won", "closedwon": "closed_won", "closed lost": "closed_lost", "closedlost": "closed_lost"}
COUNTRIES = {"uae": "UAE", "usa": "USA", "uk": "United Kingdom"}
COMPANY_WORDS = (
    "ltd", "inc", "pte", "co", "co.", "gmbh", "ab", "ltda", "holdings", "partners", "studio", "group", "solutions",
    "trading", "freight", "retail", "consulting", "robotics", "analytics", "ventures", "digital", "sons", "bros", "&",
    "and", "the",
)
PHONE_EXTENSION = r"\s*(?:ext|x|ext\.)\s*\d+$"
FENCE_START, FENCE_END = r"^```(?:json)?\s*", r"\s*```$"
LIFECYCLES = {
    "lead": "Lead", "marketing qualified lead": "Marketing Qualified Lead", "mql": "Marketing Qualified Lead",
    "sales qualified lead": "Sales Qualified Lead", "sql": "Sales Qualified Lead", "opportunity": "Opportunity",
    "customer": "Customer", "other": "Other",
}
HONORIFIC = r"(?iuU)^(?:dr|mr|mrs|ms|prof)\.?\s+"


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode spaces included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` names it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mapped(key: Column, values: dict[str, str]) -> Column:
    """The value of ``key`` in a constant table, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def status(raw: Column) -> Column:
    clean = F.lower(strip(F.regexp_replace(strip(raw), '^"+|"+$', "")))
    return F.coalesce(_mapped(clean, {s: s for s in STATUSES} | STATUS_ALIASES), F.lit("new"))


def phone(raw: Column) -> Column:
    """Digits without a trailing extension; null if fewer than seven."""
    digits = F.regexp_replace(F.regexp_replace(strip(raw), "(?iuU)" + PHONE_EXTENSION, ""), r"(?U)\D", "")
    # the same string if it has seven, else null
    return F.nullif(F.regexp_extract(digits, r"(?U)^\d{7,}$", 0), F.lit(""))


def name(first: Column, last: Column, full: Column) -> Column:
    """struct<first, last, full>: missing parts come from the full name, and the other way round."""
    first, last, full = blank_to_null(first), blank_to_null(last), blank_to_null(full)
    bare = strip(F.regexp_replace(full, HONORIFIC, ""))
    two = r"(?sU)^(.*\S)\s+(\S+)$"
    split = full.isNotNull() & first.isNull() & last.isNull()
    two_words = bare.rlike(two)
    return F.struct(
        F.when(split & two_words, F.regexp_extract(bare, two, 1)).when(split, F.nullif(bare, F.lit(""))).otherwise(first).alias("first"),
        F.when(split & two_words, F.regexp_extract(bare, two, 2)).when(~split, last).alias("last"),
        F.coalesce(full, F.when(first.isNotNull() & last.isNotNull(), F.concat_ws(" ", first, last)), first, last, F.lit("")).alias("full"),
    )


def date(raw: Column) -> Column:
    """Timestamp of ISO 8601 text, or of day and month with slashes (US order first) or dashes; else null. Naive times are UTC."""
    return _bind(strip(raw), _date)


def _date(x: Column) -> Column:
    clock = r"\d{2}(?::\d{2}(?::\d{2}(?:\.\d{3}|\.\d{6})?)?)?"
    day = F.substring(x, 1, 10)
    rest = F.replace(F.substring(x, 12, 40), F.lit("Z"), F.lit("+00:00"))

    def stamped(r: Column) -> Column:
        time = F.regexp_extract(r, rf"^({clock})", 1)
        zone = F.coalesce(F.nullif(F.regexp_extract(r, r"([+-]\d{2}:\d{2})$", 1), F.lit("")), F.lit("+00:00"))
        filled = F.concat(time, F.substr(F.lit("00:00:00"), F.length(time) + 1))
        text = F.concat(day, F.lit(" "), F.when(F.length(time) < 8, filled).otherwise(time), zone)
        return F.when(F.length(time) > 8, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]xxx"))).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssxxx")))

    iso = F.when(x.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}.{clock}(?:Z|[+-]\d{{2}}:\d{{2}})?$"), _bind(rest, stamped))
    loose = lambda pattern, text: F.when(x.rlike(pattern), F.try_to_timestamp(x, F.lit(text)))
    return F.coalesce(
        loose(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        iso,
        loose(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        loose(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        loose(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
        loose(r"^\d{8}$", "yyyyMMdd"),
    )


def title(x: Column) -> Column:
    """Each run of letters with its first letter in upper case, the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 2147483647))), "")


def country(raw: Column) -> Column:
    return _bind(blank_to_null(raw), lambda clean: F.coalesce(_mapped(F.lower(clean), COUNTRIES), title(clean)))


def owner(raw: Column) -> Column:
    return blank_to_null(raw)


def email(raw: Column) -> Column:
    return F.nullif(F.lower(strip(raw)), F.lit(""))


def company(raw: Column) -> Column:
    """Words in order without legal forms and common words (all words if none is left)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(strip(F.coalesce(raw, F.lit("")))), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")

    def kept(all_words: Column) -> Column:
        some = F.filter(all_words, lambda w: ~w.isin(*COMPANY_WORDS))
        return _bind(some, lambda s: F.array_join(F.array_sort(F.when(F.size(s) > 0, s).otherwise(all_words)), " "))

    return _bind(words, kept)


def lifecycle(raw: Column) -> Column:
    return F.when(raw != "", _bind(strip(raw), lambda clean: F.coalesce(_mapped(F.lower(clean), LIFECYCLES), clean)))


def whole_number(raw: Column, kind: str) -> Column:
    """A whole number of ``kind``, or null."""
    return strip(raw).try_cast(kind)


def fenced_json(raw: Column, schema: str) -> Column:
    """A reply parsed as JSON, without a code fence around it; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(raw), FENCE_START, ""), FENCE_END, "")
    return F.from_json(bare, schema)
