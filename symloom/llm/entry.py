"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import docpairs, leakage, packing, pii, provenance, secrets
from symloom.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docpairs.describe(*(table(spark, sf_dir, t) for t in ("code_functions", "code_symbols", "defines_rel", "code_sources")))
    return found.filter("source <> 'comment'").select("function_id")  # comments compete, but only own texts count here


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(*(table(spark, sf_dir, t) for t in ("code_functions", "code_symbols", "defines_rel", "code_sources")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = provenance.classify(table(spark, sf_dir, "code_files"), table(spark, sf_dir, "code_sources"))
    return judged.filter("kind <> 'hand_written'").select("file_id")


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.classify(table(spark, sf_dir, "code_files"), table(spark, sf_dir, "code_sources"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "code_sources"), table(spark, sf_dir, "code_variables"))
    return found.select("origin", "record_key", "line_no").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact(table(spark, sf_dir, "code_sources"), table(spark, sf_dir, "code_variables"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.report(leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), reordered=True))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "pii_type").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p3_found, p3_kinds, p4_found, p4_redacted, p6_containers, p6_fill, p7_found, p7_report, p8_found, p8_redacted)}


def oracle_sql() -> dict[str, str]:
    return {}
