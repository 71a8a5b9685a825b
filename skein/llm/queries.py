"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import chat, html, mixing, pii, quality, sharding, simhash, toxicity, urls, winnow


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_simhash": simhash.op2_simhash,
        "op3_mix": mixing.op3_mix,
        "op4_shards": sharding.op4_shards,
        "op5_quality": quality.op5_quality,
        "op6_urls": urls.op6_urls,
        "op7_decontaminate": winnow.op7_decontaminate,
        "op8_main_text": html.op8_main_text,
        "op9_chat": chat.op9_chat,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": mixing.ORACLE_OP3, "op5_quality": quality.ORACLE_OP5, "op7_decontaminate": winnow.ORACLE_OP7, "op9_chat": chat.ORACLE_OP9}
