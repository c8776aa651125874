"""Questions to a language model, a DataFrame of prompts at a time.

A ``Model`` gets rows of key and prompt and gives back key and reply. Replies
are parsed as JSON, with or without a code fence; a reply that is none, and a
model that fails, count as no answer.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import fenced_json
from ..schemas import CHANNELS
from ..storage import written

_log = logging.getLogger(__name__)

#: Characters of the notes that a model gets to see of a lead.
NOTES_SHOWN = 200


class Model(Protocol):
    def reply(self, prompts: DataFrame) -> DataFrame:
        """key, reply of ``prompts`` (key string, prompt string); null or no row where there is none."""


class CalledModel:
    """A model behind a Python function of one prompt, called in the workers; a call that fails is tried ``retries`` times more."""

    def __init__(self, call: Callable[[str], str | None], retries: int = 2):
        self.call, self.retries = call, retries

    def reply(self, prompts: DataFrame) -> DataFrame:
        call, retries = self.call, self.retries

        def ask(prompt: str) -> str | None:
            for _ in range(retries + 1):
                try:
                    return call(prompt)
                except Exception as error:  # whatever a service raises is no answer
                    _log.warning("a model call failed: %s", error)
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                replies = [ask(p) for p in batch.column("prompt").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(replies, pa.string())], names=["key", "reply"])

        return prompts.select("key", "prompt").mapInArrow(run, "key string, reply string")


def answers(model: Model, prompts: DataFrame, schema: str) -> DataFrame:
    """key and ``answer`` (a struct of ``schema``, null where there is none), asked once and written."""
    empty = prompts.sparkSession.createDataFrame([], f"key string, answer struct<{schema}>")
    try:
        replies = model.reply(prompts).select("key", fenced_json(F.col("reply"), f"struct<{schema}>").alias("answer"))
        return written(replies)
    except Exception as error:
        _log.warning("the model gave no answers: %s", error)
        return empty


def source_prompt(notes: Column) -> Column:
    return F.concat(
        F.lit("Where did this lead come from, according to the note? Reply with a JSON object and nothing else.\n\nNote: \""), notes,
        F.lit(f"\"\n\nchannel: one of {', '.join(CHANNELS)}\n" + 'Form: {"channel": "...", "detail": "what the note says of the source"}'),
    )


def sources(model: Model, notes: DataFrame) -> DataFrame:
    """notes, channel, detail of the distinct ``notes`` that the model knows a source of; an unknown channel is Other."""
    asked = notes.select("notes").distinct().withColumn("key", F.sha2("notes", 256))
    asked = written(asked)
    found = answers(model, asked.select("key", source_prompt(F.col("notes")).alias("prompt")), "channel: string, detail: string")
    channel = F.when(F.col("answer.channel").isin(*CHANNELS), F.col("answer.channel")).otherwise("Other")
    found = found.filter("answer.channel IS NOT NULL").select(F.col("key").alias("k"), channel.alias("channel"), F.coalesce("answer.detail", F.lit("")).alias("detail"))
    return asked.join(found, F.col("key") == F.col("k")).select("notes", "channel", "detail")


def _described(lead: Column) -> Column:
    text = lambda c, other: F.coalesce(lead[c], F.lit(other))
    job = F.coalesce(F.nullif(lead["job_title"], F.lit("")), F.lit("N/A"))
    lines = {"Name": text("full_name", "None"), "Email": text("email", "None"), "Phone": text("phone_number", "None"), "Company": text("company_name", "None"), "Job title": job}
    parts = [F.concat(F.lit(f"- {k}: "), v) for k, v in lines.items()]
    return F.concat_ws("\n", *parts, F.concat(F.lit("- Notes: "), F.substring(text("notes", ""), 1, NOTES_SHOWN)))


def pair_prompt(one: Column, two: Column) -> Column:
    return F.concat(
        F.lit("Are these two CRM records the same person? Reply with a JSON object and nothing else.\n\nFirst:\n"), _described(one), F.lit("\n\nSecond:\n"), _described(two),
        F.lit('\n\nForm: {"is_duplicate": true or false, "confidence": 0.0 to 1.0, "explanation": "in a few words"}'),
    )


class ModelVerifier:
    """Remarks on pairs of leads by a model."""

    def __init__(self, model: Model):
        self.model = model

    def remarks(self, pairs: DataFrame) -> DataFrame:
        key = F.concat_ws("-", "lead_id_1", "lead_id_2")
        asked = pairs.select(key.alias("key"), "lead_id_1", "lead_id_2", pair_prompt(F.col("lead_1"), F.col("lead_2")).alias("prompt"))
        found = answers(self.model, asked.select("key", "prompt"), "is_duplicate: boolean, confidence: double, explanation: string")
        return asked.join(found, "key").select("lead_id_1", "lead_id_2", F.col("answer.explanation").alias("remark"))
