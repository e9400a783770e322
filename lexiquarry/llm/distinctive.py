"""Problem 3: how characteristic a term is of a record.

Residual inverse document frequency: the observed idf of a term, ln(N / n), minus the one
that a Poisson model expects from the term's collection frequency,
-ln(1 - exp(-cf / N)), multiplied by the term's frequency in the record. A term spread by
chance has a residual near 0; one concentrated in few records a high one. The expectation
is computed by expm1, since 1 - exp(-x) loses all digits where x is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.workspace import fits_broadcast, materialize

#: Term statistics up to this many bytes, proven by a count, are broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20


def term_statistics(pairs: DataFrame) -> DataFrame:
    """(term, n LONG, cf LONG): records that hold the term, and its occurrences. Summed before the shuffle."""
    return pairs.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("cf"))


def residual_statistics(stats: DataFrame, n_records: int) -> DataFrame:
    """Add ``expected`` and ``residual`` to (n, cf) of terms in a collection of so many records."""
    total = F.lit(float(max(n_records, 1)))
    expected = -F.log(-F.expm1(-F.col("cf") / total))
    return stats.withColumns({"expected": expected, "residual": F.log(total / F.col("n")) - expected})


def residual_idf(pairs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Score every (term, doc_id, tf) row; see the module for the formula.

    Adds n, cf, expected, residual, score (= tf * residual) and weight
    (= tf * (residual + expected), the part that was observed). Scores are rounded to 6
    decimals. ``pairs`` has one row per term and record without nulls
    (:func:`lexiquarry.llm.record_terms.record_terms`) and should be materialized: it is
    read three times. N is the number of records in ``pairs``; an empty table gives no rows.

    The statistics are broadcast if they are proven small. Else the join shuffles on the
    term, where the engine's skew join splits the few heavy terms.
    """
    n_records = pairs.select("doc_id").distinct().count()
    stats = materialize(residual_statistics(term_statistics(pairs), n_records), "term-statistics")
    side = F.broadcast(stats) if fits_broadcast(stats, broadcast_bytes) else stats
    return pairs.join(side, "term").withColumns(
        {"score": F.round(F.col("tf") * F.col("residual"), 6), "weight": F.round(F.col("tf") * (F.col("residual") + F.col("expected")), 6)}
    )


def most_characteristic(scored: DataFrame, by: str = "score") -> DataFrame:
    """(doc_id, term, <by>): of each record the term with the highest value; of equals the first in byte order.

    A running best is kept per record before the shuffle, so no record's terms are gathered in one task.
    """
    best = F.min(F.struct((F.lit(0.0) - F.col(by)).alias("v"), F.col("term"))).alias("_best")
    return scored.groupBy("doc_id").agg(best).select("doc_id", F.col("_best.term").alias("term"), (F.lit(0.0) - F.col("_best.v")).alias(by))
