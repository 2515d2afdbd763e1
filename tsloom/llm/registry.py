"""Queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsloom.llm import audit, decontam, extract, licenses, linededup, lm, mixing, neardup, ogg, pii, quality, repair, urlrules


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_licenses": licenses.op2_licenses,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_ogg": ogg.op5_ogg,
    "op6_decontam": decontam.op6_decontam,
    "op7_url_rules": urlrules.op7_url_rules,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_lm_score": lm.op9_lm_score,
    "op10_pii": pii.op10_pii,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_html_extraction": extract.op13_html_extraction,
    "pipeline": _pipeline,
}
SQL: dict[str, str] = {
    "op4_mixing": mixing.SQL,
    "op6_decontam": decontam.SQL,
    "op7_url_rules": urlrules.SQL,
    "op11_filter_audit": audit.SQL,
    "op12_conversation_repair": repair.SQL,
}
