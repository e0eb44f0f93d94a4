"""The queries on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from amperelake.common import cut, table
from amperelake.llm import abuse, packing, tokens


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(cut(tokens.token_counts(table(spark, d, "documents"))))


def p8_certificate(spark: SparkSession, d: str) -> DataFrame:
    return packing.certificate(p8_containers(spark, d))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    model = abuse.fit_labels(table(spark, d, "review_label"))
    return abuse.scored(table(spark, d, "documents"), model, "doc_id", "text", "source"), model.threshold


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    scores, threshold = _scored(spark, d)
    return scores.where(f"score >= {threshold!r}").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(*_scored(spark, d))


QUERIES = {f.__name__: f for f in (p7_ids, p7_counts, p8_containers, p8_certificate, p9_found, p9_scores, p9_rates)}
SQL: dict[str, str] = {}
