"""The queries of this package, and their SQL where it can be given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, counts, decontaminate, minhash, packing, pii, quality, sentencepieces, substrings, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_url_filters": urls.op2_url_filters,
        "op3_minhash": minhash.op3_minhash,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_repeated_substrings": substrings.op5_repeated_substrings,
        "op6_sentencepiece": sentencepieces.op6_sentencepiece,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_token_packing": packing.op8_token_packing,
        "op9_pii": pii.op9_pii,
        "op10_token_counts": counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.OP1_SQL,
        "op2_url_filters": urls.OP2_SQL,
        "op3_minhash": minhash.OP3_SQL,
        "op4_quality_rules": quality.OP4_SQL,
        "op5_repeated_substrings": substrings.OP5_SQL,
        "op9_pii": pii.OP9_SQL,
    }
