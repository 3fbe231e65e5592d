"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import licenses, mixing, oracle, secrets
from logweave.llm.common import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.packing import pack_documents, pieces_digest

    return pieces_digest(pack_documents(read_table(spark, sf_dir, "documents")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.licenses import digest, scan_licenses

    return digest(scan_licenses(read_table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.secrets import digest, scan_secrets

    return digest(scan_secrets(read_table(spark, sf_dir, "documents")))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.lm import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.line_dedup import dedup_lines, kept_digest

    return kept_digest(dedup_lines(read_table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.quality import score_quality

    scored = score_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.mixing import digest, mix

    return digest(mix(read_table(spark, sf_dir, "documents")))


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.vptree import nearest

    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.quality_rules import score_rules

    good = read_table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return score_rules(read_table(spark, sf_dir, "documents"), good)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logweave.llm.simhash import hex64, near_duplicates

    members = near_duplicates(read_table(spark, sf_dir, "documents"))
    return members.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_licenses, op3_secrets, op4_lm_scores, op5_line_dedup, op6_quality, op7_mixing, op8_vptree, op9_quality_rules, op10_simhash)
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": licenses.oracle_sql(),
    "op3_secrets": secrets.oracle_sql(),
    "op5_line_dedup": oracle.LINE_DEDUP,
    "op7_mixing": mixing.oracle_sql(),
    "op8_vptree": oracle.NEAREST,
}
