"""Scores of candidate pairs: five weighted signals and a sentence that explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import company, strip
from ..functions.similarity import jaro_winkler
from ..schemas import SIGNALS
from .blocking import phone_digits

# Weights in the order they are added, and the threshold.
WEIGHTS = {"email": 0.35, "phone": 0.25, "name": 0.20, "company": 0.15, "notes_hint": 0.05}
THRESHOLD = 0.6

FEATURES = ("email", "phone", "name", "first", "last", "company", "hint", "raw_email", "raw_name", "raw_company")


def feature_struct() -> Column:
    """What scoring reads of a lead, as one struct of the columns of a table of leads."""
    low = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit(""))))
    values = {
        "email": low("email"),
        "phone": F.coalesce(phone_digits(), F.lit("")),
        "name": low("full_name"),
        "first": low("first_name"),
        "last": low("last_name"),
        "company": company(F.col("company_name")),
        "hint": F.coalesce(F.lower("notes").contains("possible duplicate"), F.lit(False)),
        "raw_email": F.col("email"),
        "raw_name": F.col("full_name"),
        "raw_company": F.col("company_name"),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def features(leads: DataFrame) -> DataFrame:
    """id and ``f``: what scoring reads, prepared once per lead instead of once per pair."""
    return leads.select("id", feature_struct().alias("f"))


def _local(email: Column) -> Column:
    return F.get(F.split(email, "@", -1), F.lit(0))


def _domain(email: Column) -> Column:
    return F.coalesce(F.get(F.split(email, "@", -1), F.lit(1)), F.lit(""))


def email_score(a: Column, b: Column) -> Column:
    x, y = a["email"], b["email"]
    near = F.when(jaro_winkler(_local(x), _local(y)) >= 0.8, 0.7).otherwise(0.3)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(_domain(x) == _domain(y), near).otherwise(0.0)


def phone_score(a: Column, b: Column) -> Column:
    x, y = a["phone"], b["phone"]
    tail = lambda p: F.right(p, F.lit(10))
    long = (F.length(x) >= 10) & (F.length(y) >= 10)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(long & (tail(x) == tail(y)), 0.8).otherwise(0.0)


def _bind(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def name_score(a: Column, b: Column) -> Column:
    x, y = a["name"], b["name"]
    initial = lambda s: F.substring(s, 1, 1)
    same_last = (a["last"] != "") & (a["last"] == b["last"]) & (a["first"] != "") & (b["first"] != "") & (initial(a["first"]) == initial(b["first"]))
    loose = _bind(jaro_winkler(x, y), lambda s: F.when(s >= 0.85, s).when(same_last, 0.6).otherwise(s))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(loose)


def company_score(a: Column, b: Column) -> Column:
    x, y = a["company"], b["company"]
    words = lambda s: F.array_distinct(F.split(s, " ", -1))
    shared = F.size(F.array_intersect(words(x), words(y))) / F.greatest(F.size(words(x)), F.size(words(y)))
    loose = _bind(jaro_winkler(x, y), lambda s: F.when(s >= 0.85, s).when(shared >= 0.6, F.greatest(shared, s)).otherwise(F.greatest(s - 0.3, F.lit(0.0))))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(loose)


def hint_score(a: Column, b: Column) -> Column:
    return F.when(a["hint"] | b["hint"], 1.0).otherwise(0.0)


SCORES = {"email": email_score, "phone": phone_score, "name": name_score, "company": company_score, "notes_hint": hint_score}


def most(a: Column, b: Column, phone: Column, hint: Column) -> Column:
    """What a pair can reach at most, without a look at any string similarity."""
    email = F.when((a["email"] == "") | (b["email"] == ""), 0.0).when(a["email"] == b["email"], 1.0).when(_domain(a["email"]) == _domain(b["email"]), 0.7).otherwise(0.0)
    return email * WEIGHTS["email"] + phone * WEIGHTS["phone"] + WEIGHTS["name"] + WEIGHTS["company"] + hint * WEIGHTS["notes_hint"]


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str = "lead_id_1", right_id: str = "lead_id_2", at_least: float | None = THRESHOLD) -> DataFrame:
    """``pairs`` with one column for each signal, confidence (not rounded) and both features ``a`` and ``b``.

    Cheap signals come first: with ``at_least``, pairs that could not reach it
    even with equal names and companies are dropped ahead of the similarities.
    """
    x = features(left).select(F.col("id").alias(left_id), F.col("f").alias("a"))
    y = features(right).select(F.col("id").alias(right_id), F.col("f").alias("b"))
    out = pairs.join(x, left_id).join(y, right_id)
    a, b = F.col("a"), F.col("b")
    out = out.withColumns({"phone": phone_score(a, b), "notes_hint": hint_score(a, b)})
    if at_least is not None:
        out = out.filter(most(a, b, F.col("phone"), F.col("notes_hint")) >= at_least - 1e-9)
    out = out.withColumns({k: SCORES[k](a, b) for k in ("email", "name", "company")})
    total = None
    for k in SIGNALS:
        part = F.col(k) * WEIGHTS[k]
        total = part if total is None else total + part
    out = out.withColumn("confidence", total)
    return out if at_least is None else out.filter(F.col("confidence") >= at_least)


def explanation(a: Column, b: Column) -> Column:
    text = lambda x: F.coalesce(x, F.lit("None"))
    names = F.concat(F.lit(" ("), text(a["raw_name"]), F.lit(" ↔ "), text(b["raw_name"]), F.lit(")"))
    clauses = F.concat_ws(
        "; ",
        F.when(F.col("email") >= 1.0, F.concat(F.lit("Exact email match ("), text(a["raw_email"]), F.lit(")"))).when(F.col("email") >= 0.5, "Similar email (same domain)"),
        F.when(F.col("phone") >= 1.0, "Exact phone match").when(F.col("phone") >= 0.7, "Phone digits match (format difference)"),
        F.when(F.col("name") >= 0.85, F.concat(F.lit("Name very similar"), names)).when(F.col("name") >= 0.5, F.concat(F.lit("Name partially matches"), names)),
        F.when(F.col("company") >= 0.85, F.concat(F.lit("Same company ("), text(a["raw_company"]), F.lit(" ≈ "), text(b["raw_company"]), F.lit(")"))),
        F.when(F.col("notes_hint") >= 1.0, "Notes contain 'possible duplicate' flag"),
    )
    return F.when(clauses == "", "Multiple weak signals").otherwise(clauses)


def candidates(scored_pairs: DataFrame) -> DataFrame:
    """lead_id_1, lead_id_2, rounded confidence and signals, explanation."""
    return scored_pairs.select(
        "lead_id_1",
        "lead_id_2",
        F.round("confidence", 4).alias("confidence"),
        F.struct(*[F.round(k, 4).alias(k) for k in SIGNALS]).alias("match_reasons"),
        explanation(F.col("a"), F.col("b")).alias("explanation"),
    )
