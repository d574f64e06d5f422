"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import chat, decontaminate, fixity, mixture, quality, rules, simhash, substrings, toxicity, urls

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_simhash": simhash.op2_simhash,
    "op3_fixity_audit": fixity.op3_fixity_audit,
    "op4_url_filter": urls.op4_url_filter,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_chat_format": chat.op6_chat_format,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_substrings": substrings.op8_substrings,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixture": mixture.op10_mixture,
}
_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_fixity_audit": fixity.OP3_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_substrings": substrings.OP8_SQL,
    "op10_mixture": mixture.OP10_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
