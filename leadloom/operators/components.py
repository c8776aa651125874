"""Clusters: connected components of pairs, kept as a table throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discarded, written


def components(edges: DataFrame, a: str = "lead_id_1", b: str = "lead_id_2") -> DataFrame:
    """id, component (the least id that can be reached), for every id that has an edge.

    Labels take the least of their neighbours', then the label of that label,
    until none changes. Every round is written to the shared folder, so lineage
    does not grow and lost executors cost one round; the one before is deleted.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = table = written(both.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("component")))
    changed = True
    while changed:
        low = both.join(labels, both["y"] == labels["id"]).groupBy(F.col("x").alias("n")).agg(F.min("component").alias("low"))
        near = labels.join(low, labels["id"] == low["n"]).select("id", "component", F.least("component", "low").alias("low"))
        top = labels.select(F.col("id").alias("t"), F.col("component").alias("top"))
        label = F.least("low", "top")
        new = written(near.join(top, F.col("low") == F.col("t")).select("id", label.alias("component"), (label != F.col("component")).alias("changed")))
        changed = not new.filter("changed").isEmpty()
        discarded(table)
        labels, table = new.select("id", "component"), new
    discarded(both)
    labels._leadloom_path = table._leadloom_path  # so that it can be discarded like any table
    return labels


def group_id(component: Column) -> Column:
    """A UUID-shaped name of a cluster that is the same in every run."""
    h = F.md5(F.concat(F.lit("lead-cluster-"), component.cast("string")))
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def clustered(candidates: DataFrame) -> DataFrame:
    """``candidates`` with the group_id of their cluster."""
    found = components(candidates).select(F.col("id").alias("c_id"), group_id(F.col("component")).alias("group_id"))
    return candidates.join(found, F.col("lead_id_1") == F.col("c_id")).drop("c_id")


def members(candidates: DataFrame) -> DataFrame:
    """lead_id, group_id of every lead that a candidate names."""
    ids = F.explode(F.array("lead_id_1", "lead_id_2")).alias("lead_id")
    return candidates.select(ids, "group_id").distinct()


def with_group(leads: DataFrame, candidates: DataFrame) -> DataFrame:
    """``leads`` with dedup_group_id set for members and null for all others."""
    m = members(candidates).select(F.col("lead_id").alias("m_id"), F.col("group_id").alias("m_group"))
    out = leads.drop("dedup_group_id").join(m, F.col("id") == F.col("m_id"), "left")
    return out.withColumn("dedup_group_id", F.col("m_group")).drop("m_id", "m_group")


def clusters(candidates: DataFrame, id_column: str | None = None) -> DataFrame:
    """group_id, confidence (the greatest), explanation (distinct ones in order), lead_ids; best first.

    A candidate without a group is one by itself, named by ``id_column`` or its pair.
    """
    own = F.col(id_column).cast("string") if id_column else F.concat_ws("-", "lead_id_1", "lead_id_2")
    named = candidates.withColumn("group_id", F.coalesce("group_id", F.concat(F.lit("pair-"), own)))
    text = F.filter(F.collect_set("explanation"), lambda e: e != "")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("lead_id_1", "lead_id_2")))))
    out = named.groupBy("group_id").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(text), "; ").alias("explanation"), ids.alias("lead_ids"))
    return out.orderBy(F.desc("confidence"), "group_id")


def clusters_with_leads(candidates: DataFrame, leads: DataFrame) -> DataFrame:
    """``clusters`` with the leads of each by id; ids without a lead are left out of ``leads``."""
    lead = F.struct("id", *[c for c in leads.columns if c != "id"])
    m = members(candidates).join(leads.select(lead.alias("lead")), F.col("lead_id") == F.col("lead.id"))
    rows = m.groupBy(F.col("group_id").alias("g")).agg(F.array_sort(F.collect_list("lead"), lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)).alias("leads"))
    return clusters(candidates).join(rows, F.col("group_id") == F.col("g"), "left").drop("g").orderBy(F.desc("confidence"), "group_id")
