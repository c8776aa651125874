"""The full resolution of leads: pairs, scores, model remarks, clusters."""

from __future__ import annotations

import logging
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocking import candidate_pairs
from ..operators.components import clustered, with_group
from ..operators.scoring import THRESHOLD, candidates, scored
from ..storage import written

_log = logging.getLogger(__name__)
MODEL_THRESHOLD, MODEL_PAIRS = 0.8, 5
REMARK = " | LLM: "


class Verifier(Protocol):
    """Remarks of a model on pairs: ``remarks`` gets lead_id_1, lead_id_2, lead_1, lead_2 and returns lead_id_1, lead_id_2, remark."""

    def remarks(self, pairs: DataFrame) -> DataFrame: ...


class Resolution(NamedTuple):
    candidates: DataFrame
    leads: DataFrame


def find_candidates(leads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return candidates(scored(candidate_pairs(leads), leads, leads, at_least=threshold))


def shortlist(found: DataFrame, threshold: float = MODEL_THRESHOLD, most: int = MODEL_PAIRS) -> DataFrame:
    """The pairs that a model is asked about: the best ``most`` of those from ``threshold`` on."""
    return found.filter(F.col("confidence") >= threshold).orderBy(F.desc("confidence"), "lead_id_1", "lead_id_2").limit(most)


def remembered(earlier: DataFrame) -> DataFrame:
    """lead_id_1, lead_id_2, remark of candidates that a model has seen before."""
    at = F.instr("explanation", F.lit(REMARK))
    return earlier.filter(at > 0).select("lead_id_1", "lead_id_2", F.substr("explanation", at + len(REMARK)).alias("remark"))


def remarked(found: DataFrame, leads: DataFrame, verifier: Verifier | None, earlier: DataFrame | None = None) -> DataFrame:
    """``found`` with remarks of ``verifier`` added to the explanations of the shortlist.

    Known remarks are used again without a question; a verifier that fails adds none.
    """
    if verifier is None:
        return found
    asked = shortlist(found).select("lead_id_1", "lead_id_2")
    known = remembered(earlier) if earlier is not None else found.sparkSession.createDataFrame([], "lead_id_1 bigint, lead_id_2 bigint, remark string")
    known = asked.join(known, ["lead_id_1", "lead_id_2"])
    lead = F.struct(*leads.columns)
    new = asked.join(known, ["lead_id_1", "lead_id_2"], "left_anti")
    new = new.join(leads.select(lead.alias("lead_1")), F.col("lead_id_1") == F.col("lead_1.id")).join(leads.select(lead.alias("lead_2")), F.col("lead_id_2") == F.col("lead_2.id"))
    known = known.filter("remark <> ''")
    try:
        remarks = written(known.unionByName(verifier.remarks(new).select("lead_id_1", "lead_id_2", "remark").filter("remark <> ''")))
    except Exception as error:
        _log.warning("the verifier gave no remarks: %s", error)
        remarks = written(known)
    out = found.join(remarks, ["lead_id_1", "lead_id_2"], "left")
    return out.withColumn("explanation", F.concat("explanation", F.coalesce(F.concat(F.lit(REMARK), "remark"), F.lit("")))).drop("remark")


def resolve(leads: DataFrame, verifier: Verifier | None = None, earlier: DataFrame | None = None, keep_reviews: bool = False, threshold: float = THRESHOLD) -> Resolution:
    """Candidates with status and group, and ``leads`` with their groups.

    Every run replaces earlier candidates; with ``keep_reviews`` the status of
    pairs that were reviewed stays.
    """
    found = written(find_candidates(leads, threshold))
    found = clustered(remarked(found, leads, verifier, earlier)).withColumn("status", F.lit("pending"))
    if keep_reviews and earlier is not None:
        before = earlier.select("lead_id_1", "lead_id_2", F.col("status").alias("before"))
        found = found.join(before, ["lead_id_1", "lead_id_2"], "left").withColumn("status", F.coalesce("before", "status")).drop("before")
    found = written(found.select("lead_id_1", "lead_id_2", "confidence", "match_reasons", "explanation", "status", "group_id"))
    return Resolution(found, with_group(leads, found))
