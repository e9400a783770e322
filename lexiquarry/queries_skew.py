"""Queries of problem 2 (a few keys holding most records) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.operators.skew import heavy_keys, key_states
from lexiquarry.workspace import materialize

HEAVY_ONE_IN = 70


def _term_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_states(spark.read.parquet(f"{sf_dir}/term_positions.parquet"), "term", "m_doc_id", "pos")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(materialize(_term_states(spark, sf_dir), "term-states"), "term", HEAVY_ONE_IN)


def p2_term_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_states(spark, sf_dir)


def p2_posting_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.read.parquet(f"{sf_dir}/postings.parquet").select("term", "m_doc_id", F.explode("m_positions").alias("pos"))
    return key_states(flat, "term", "m_doc_id", "pos")


QUERIES = {"p2_found": p2_found, "p2_term_states": p2_term_states, "p2_posting_states": p2_posting_states}

_STATES = """
WITH occ AS ({occ}), per_doc AS (SELECT term, m_doc_id, count(*) AS c FROM occ GROUP BY term, m_doc_id)
SELECT term, CAST(sum(c) AS BIGINT) AS occurrences, count(*) AS records, max(c) AS max_in_record FROM per_doc GROUP BY term
"""
SQL = {
    "p2_found": f"""
WITH occ AS (SELECT DISTINCT term, m_doc_id, pos FROM term_positions WHERE term IS NOT NULL AND m_doc_id IS NOT NULL AND pos IS NOT NULL)
SELECT term FROM occ GROUP BY term HAVING count(*) * {HEAVY_ONE_IN} >= (SELECT count(*) FROM occ)
""",
    "p2_term_states": _STATES.format(occ="SELECT DISTINCT term, m_doc_id, pos FROM term_positions WHERE term IS NOT NULL AND m_doc_id IS NOT NULL AND pos IS NOT NULL"),
    "p2_posting_states": _STATES.format(
        occ="SELECT DISTINCT term, m_doc_id, pos FROM (SELECT term, m_doc_id, unnest(m_positions) AS pos FROM postings) WHERE term IS NOT NULL AND m_doc_id IS NOT NULL AND pos IS NOT NULL"
    ),
}
