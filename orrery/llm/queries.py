"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, hard_negatives, jaccard_join, licenses, line_dedup, mixing, pii, quality, secret_scan, sort_means, sql, tokens, url_filter, warc
from orrery.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark(table(spark, sf_dir, "documents"))
    gone = F.array_sort(F.concat("exact", "near"))
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in ("exact", "near")]
    return marked.select("doc_id", "n_lines", *counts, F.array_join(gone.cast("array<string>"), ",").alias("gone"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allot(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.histogram(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    noisy = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", noisy.alias("label"), F.col("embedding").alias("vec"))
    return hard_negatives.mine(rows, vec_id % 100 == 0)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return sort_means.report(*sort_means.cluster(rows))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").alias("payload"))
    read = warc.round_trip(spark, rows)
    return read.select(F.col("id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def queries() -> dict[str, Query]:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_secret_scans": op2_secret_scans,
        "op3_quality_rules": op3_quality_rules,
        "op4_url_filters": op4_url_filters,
        "op5_line_dedup": op5_line_dedup,
        "op7_decontamination": op7_decontamination,
        "op6_source_mixing": op6_source_mixing,
        "op8_personal_data": op8_personal_data,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_token_counts": op10_token_counts,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_warc_archives": op13_warc_archives,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
