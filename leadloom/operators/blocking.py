"""Blocking: typed keys of leads and the pairs that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import company, phone, strip

#: Buckets of more leads than this are noise and give no pairs.
MOST_PER_BUCKET = 50


def phone_digits() -> Column:
    return F.coalesce(F.nullif(F.col("phone_normalized"), F.lit("")), phone(F.col("phone_number")))


def _prefix(x: Column) -> Column:
    """First three letters, if there are two at least."""
    head = F.substring(F.lower(strip(x)), 1, 3)
    return F.when(F.length(head) >= 2, head)


def _key_columns() -> dict[str, Column]:
    email = F.nullif(F.col("email"), F.lit(""))
    domain = F.when(email.contains("@"), F.lower(F.get(F.split(email, "@", -1), F.lit(1))))
    digits = phone_digits()
    organisation = F.nullif(company(F.col("company_name")), F.lit(""))
    return {
        "email_exact": F.lower(strip(email)),
        "phone_normalized": F.when(F.length(digits) >= 7, digits),
        "phone_suffix_10": F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))),
        "domain_lastname": F.concat(domain, F.lit("|"), _prefix(F.col("last_name"))),
        "company_firstname": F.concat(organisation, F.lit("|"), _prefix(F.col("first_name"))),
        "domain": domain,
    }


def _exploded(leads: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key_type"), v.alias("key")) for k, v in kinds.items()]), lambda x: x["key"].isNotNull())
    return leads.select("id", F.explode(pairs).alias("k")).select("id", "k.key_type", "k.key")


def keys(leads: DataFrame) -> DataFrame:
    """id, key_type, key: one row for each blocking key of a lead."""
    kinds = _key_columns()
    del kinds["domain"]
    return _exploded(leads, kinds)


#: Keys of telephone numbers; what shares one has a phone score, and the other way round.
PHONE_KEYS = ("phone_normalized", "phone_suffix_10")


def plain_kinds(with_contact: bool) -> dict[str, Column]:
    """Keys by kind, but those of numbers.

    ``with_contact``: for matches over a threshold that name, company and hint
    alone can't reach. Such pairs share an e-mail domain or a number, so a
    company and first name count together with the domain only.
    """
    kinds = {k: v for k, v in _key_columns().items() if k not in PHONE_KEYS}
    domain = kinds.pop("domain")
    if with_contact:
        kinds["company_firstname"] = F.concat(kinds["company_firstname"], F.lit("|"), domain)
    return kinds


def bucket_sizes(all_keys: DataFrame) -> DataFrame:
    """key_type, key, n: counted before the shuffle, so a hot key is one row per task."""
    return all_keys.groupBy("key_type", "key").agg(F.count("*").alias("n"))


def candidate_pairs(leads: DataFrame, most: int = MOST_PER_BUCKET) -> DataFrame:
    """lead_id_1 < lead_id_2 of all leads that share a key of 2 to ``most`` leads."""
    all_keys = keys(leads)
    useful = bucket_sizes(all_keys).filter((F.col("n") >= 2) & (F.col("n") <= most)).drop("n")
    kept = all_keys.join(useful, ["key_type", "key"])
    other = kept.withColumnRenamed("id", "other")
    pairs = kept.join(other, ["key_type", "key"]).filter(F.col("id") < F.col("other"))
    return pairs.select(F.col("id").alias("lead_id_1"), F.col("other").alias("lead_id_2")).distinct()
