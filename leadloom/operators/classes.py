"""Classes: leads that read alike in all but number, hint and notes, and pairs of such classes.

A score but for the number and the hint is the same for all members of two
classes, so it is computed once for them. Members of large buckets are often
alike; then there are far fewer pairs of classes than of leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import SCORES, feature_struct, most

_TEXTS = ("email", "name", "first", "last", "company")


def members(leads: DataFrame, kinds: dict[str, Column], *more: Column, hint: bool = False) -> DataFrame:
    """id, class, f (what its scores read), k (its keys), number, hint and ``more`` of each lead; with ``hint`` the hint tells classes apart as well."""
    rows = leads.select("id", feature_struct().alias("all"), F.struct(*[v.alias(c) for c, v in kinds.items()]).alias("k"), *more)
    f = F.struct(*[F.col(f"all.{c}").alias(c) for c in _TEXTS], *[F.col("all.hint").alias("hint")] * hint)
    rows = rows.withColumns({"f": f, "number": F.col("all.phone"), "hint": F.col("all.hint")}).drop("all")
    return rows.withColumn("class", F.unhex(F.md5(F.to_json(F.struct("f", "k")))))


def tail(number: Column) -> Column:
    """What two numbers with a score have in common."""
    return F.right(number, F.lit(10))


def _shared(pair: DataFrame, count: int | None = None) -> list[Column]:
    names = pair.schema["ka"].dataType.names[:count]
    return [F.coalesce(F.col("ka")[c] == F.col("kb")[c], F.lit(False)) for c in names]


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for x in flags:
        out = out | x
    return out


def plain(pair: DataFrame) -> Column:
    """Whether the classes of a ``pair`` have a key in common."""
    return _any(_shared(pair))


def keyed_pairs(left: DataFrame, right: DataFrame, within: Column) -> DataFrame:
    """class, target, a, b, ka, kb and the rest of ``right`` for all classes with a common key that fit ``within``, once each.

    ``within`` reads a and b ahead of any shuffle of pairs; of several common keys the first one gives the pair.
    """
    names = left.schema["k"].dataType.names
    at = F.array(*[F.col("k")[c] for c in names])
    x = left.select("class", F.col("f").alias("a"), F.col("k").alias("ka"), F.posexplode(at).alias("kind", "key")).filter("key IS NOT NULL")
    y = right.select(F.col("class").alias("target"), F.col("f").alias("b"), F.col("k").alias("kb"), *[c for c in right.columns if c not in ("class", "f", "k")], F.posexplode(at).alias("kind", "key"))
    out = x.join(y.filter("key IS NOT NULL"), ["kind", "key"])
    earlier = _any([(F.col("kind") > i) & s for i, s in enumerate(_shared(out, len(names) - 1))])
    return out.filter(~earlier & within).drop("kind", "key")


def told(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (class, target) with a, b, ka, kb."""
    x = left.select("class", F.col("f").alias("a"), F.col("k").alias("ka"))
    y = right.select(F.col("class").alias("target"), F.col("f").alias("b"), F.col("k").alias("kb"))
    return pairs.join(x, "class").join(y, "target")


def reach(phone: Column, hint: Column) -> Column:
    """What a pair can reach at most, without a look at any string similarity."""
    return most(F.col("a"), F.col("b"), phone, hint)


def with_scores(pairs: DataFrame) -> DataFrame:
    """``pairs`` with email, name and company scores."""
    return pairs.withColumns({k: SCORES[k](F.col("a"), F.col("b")) for k in ("email", "name", "company")})
