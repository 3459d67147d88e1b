"""The operators' queries over the driver's tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontamination, filter_audit, jaccard_join, licenses, mixing, pii, pseudo_likelihood, quality, repetition, secrets, suffix_dedup, warc, whitening
from shelfmark.llm.common import table


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest(spans: str, base: tuple[str, ...]) -> list[Column]:
    of_base = F.filter(spans, lambda s: s["kind"].isin(*base))
    return [*(_count(spans, k) for k in base), F.sha2(_joined(of_base), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the network's own findings, and its largest probability over all of a document's findings."""
    found = secrets.secret_findings(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", *_digest("secrets", secrets.BASE_KINDS), _count("secrets", "cnn"), F.array_max(F.transform("secrets", lambda s: s["score"])).alias("top_score"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for hosts, languages of a source for paths."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition.repetition_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return measured.select(*first, *(c for c in measured.columns if c not in first))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the scores of all spans, in the order of ``spans``."""
    found = pii.pii_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", *_digest("pii", pii.BASE_KINDS), F.transform("pii", lambda s: s["score"]).alias("scores"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scored(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


OPERATORS = (
    op1_suffix_dedup, op2_mixing, op3_secrets, op4_licenses, op5_quality_classifier, op6_quality_rules, op7_decontamination, op8_pii, op9_lm_scoring, op10_jaccard_join,
    op11_warc, op12_filter_audit, op13_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE_SQL, "op11_warc": warc.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
