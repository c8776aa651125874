"""The corpus pipeline: documents to token ids, in stages that are each written and read again.

Quality rules (documents that fail go), near-duplicates (one of each class
stays), benchmark decontamination (documents that hold an item go), personal
data (replaced in the texts), and SentencePiece encoding. All stages but the
last return the columns of ``documents``, whatever their names.

Cases: a document without a text has no words and goes with the first stage,
as do empty ones; a null id or source stays with its row; repeated rows are
near-duplicates, of which one stays; texts are read whole at every stage; an
empty table gives an empty result. Columns that documents have besides come
through all stages as they were; in the last, new columns take the place of
those with their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom import storage
from leadloom.llm import decontaminate, minhash, pii, quality, sentencepieces
from leadloom.llm.common import table, written

STAGES = [
    ("quality rules", quality.stage),
    ("near duplicates", minhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("personal data", pii.stage),
    ("token ids", sentencepieces.stage),
]

#: Near-duplicates and token ids have no SQL; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each stage's result is a table in the shared folder, and what led to it is deleted then."""
    docs, since = table(spark, sf_dir, "documents"), storage.mark(spark)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        storage.cleared(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
