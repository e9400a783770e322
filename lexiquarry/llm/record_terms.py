"""Clean (term, record, frequency) rows out of a positional index.

A posting may be sent twice or be split over rows whose positions overlap; what counts
are the distinct positions of a term in a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_terms(postings: DataFrame, term: str = "term", record: str = "m_doc_id", positions: str = "m_positions") -> DataFrame:
    """(term STRING, doc_id LONG, tf LONG): one row per term and record that holds it.

    Rows with a null term, a null record or without positions don't count, nor do null
    positions; an empty table gives no rows; other columns are ignored. Equal rows are
    dropped before the shuffle, so a posting sent any number of times stays small. The only
    shuffle is on (term, record), which cuts every heavy term by its records; a group holds
    the positions of one term in one record.
    """
    held = postings.select(F.col(term).cast("string").alias("term"), F.col(record).cast("long").alias("doc_id"), F.col(positions).alias("_at"))
    sent = held.filter("term IS NOT NULL AND doc_id IS NOT NULL AND exists(_at, x -> x IS NOT NULL)").groupBy("term", "doc_id").agg(F.collect_set("_at").alias("_sent"))
    distinct = F.size(F.array_compact(F.array_distinct(F.flatten("_sent")))).cast("long")
    return sent.select("term", "doc_id", distinct.alias("tf"))
