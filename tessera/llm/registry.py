"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat_format, flac, hard_negatives, lexical_search, licences, packing, pii, quality_mil, quality_rules, sentencepiece_scan, sharding, simhash, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_quality_mil": quality_mil.op2_quality_mil,
        "op3_flac": flac.op3_flac,
        "op4_warc": warc.op4_warc,
        "op5_sentencepiece": sentencepiece_scan.op5_sentencepiece,
        "op6_pii": pii.op6_pii,
        "op7_licences": licences.op7_licences,
        "op8_packing": packing.op8_packing,
        "op9_sharding": sharding.op9_sharding,
        "op10_simhash": simhash.op10_simhash,
        "op11_chat_format": chat_format.op11_chat_format,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    known = {"op1_quality_rules": quality_rules.OP1_SQL, "op4_warc": warc.OP4_SQL, "op11_chat_format": chat_format.OP11_SQL, "op12_lexical_search": lexical_search.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL}
    return known | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
