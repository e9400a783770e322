"""Problem 1: one form for texts that look the same.

Bodies are mapped by built-in expressions (:func:`lexiquarry.llm.seen.folded`), the few
with separate marks brought into canonical order. Each distinct mapped text meets the
collator once: SQL groups them under the collation UNICODE, which is sensitive to case and
accents but holds composed and separate accents for equal, and gives each group a canonical
member that doesn't depend on order. Records carry digests of their texts (SHA-256), by
which the members are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.seen import MARKS, UNSETTLED, folded, settled
from lexiquarry.workspace import materialize


def once(df: DataFrame, key: str, value: list[str], loaded: str | None = None) -> DataFrame:
    """(<key>, values): one row per non-null key with the values as loaded last (of equals, the greatest values; a value is more than a null)."""
    columns = ([F.col(loaded).alias("_at")] if loaded else []) + [F.col(v).alias(f"_v{i}") for i, v in enumerate(value)]
    latest = df.select(F.col(key).alias("_key"), F.struct(*columns).alias("_row")).filter("_key IS NOT NULL").groupBy("_key").agg(F.max("_row").alias("_row"))
    return latest.select(F.col("_key").alias(key), *[F.col(f"_row._v{i}").alias(v) for i, v in enumerate(value)])


# The appended ideograph is the same for all texts, so it changes no equality. It keeps the collator off its shortcut
# for Latin texts, which orders sharp s after composed and separate accents inconsistently; sorted groups would tear.
_CLASSES = """
SELECT _digest, first_value(_form) OVER class AS canonical, min(_least) OVER class AS class_id
FROM (SELECT *, concat(coalesce(_settled, _form), '一') COLLATE UNICODE AS _shown FROM {forms})
WINDOW class AS (PARTITION BY _shown ORDER BY octet_length(_form), _form ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def _digest(column: str):
    return F.unhex(F.sha2(F.col(column), 256))


def _classes(df: DataFrame, key: str, text: str, loaded: str | None) -> tuple[DataFrame, DataFrame]:
    """(records, classes): (_key, _stored, _digest), one row a key; (_digest, canonical, class_id), one row for each distinct mapped text."""
    rows = df.select(F.col(key).alias("_key"), (F.col(loaded) if loaded else F.lit(0)).alias("_at"), F.col(text).alias("_text")).filter("_key IS NOT NULL")
    marks = F.coalesce(F.col("_text").rlike(MARKS), F.lit(False))
    plain, marked = (rows.filter(c).withColumn("_form", folded(F.col("_text"))) for c in (~marks, marks))
    settling = settled(F.when(F.col("_form").rlike(UNSETTLED), F.col("_form")))  # null for texts that are in order
    both = plain.withColumn("_settled", F.lit(None).cast("string")).unionByName(marked.withColumn("_settled", settling)).withColumns({"_form": F.nullif("_form", F.lit("")), "_stored": _digest("_text")})
    # Read twice below, once without the texts, and mapping is the dearest step: written once.
    mapped = materialize(both.select("_key", "_at", "_form", "_settled", "_stored", _digest("_form").alias("_digest")), "mapped")
    latest = mapped.groupBy("_key").agg(F.max(F.struct("_at", "_stored", "_digest")).alias("_row"))
    records = materialize(latest.select("_key", "_row._stored", "_row._digest"), "records")
    # Equal mapped texts are first made one row, so a text held by a third of all records is one member.
    used = records.filter("_digest IS NOT NULL").groupBy("_digest").agg(F.min("_key").alias("_least"))
    texts = mapped.filter("_digest IS NOT NULL").groupBy("_digest").agg(F.any_value("_form").alias("_form"), F.any_value("_settled").alias("_settled"))
    return records, df.sparkSession.sql(_CLASSES, forms=texts.join(used, "_digest"))


def canonical_forms(df: DataFrame, key: str, text: str, loaded: str | None = None) -> DataFrame:
    """(key, canonical STRING, class_id): the canonical text of each record's class.

    ``canonical`` is the shortest, then the first in byte order, of the mapped texts of
    the class, so composed accents win; ``class_id`` is the least key of the class.
    Null, empty and blank texts belong to no class: both columns are null. A key that
    occurs again counts once, as loaded last (of texts loaded at the same time, the one
    with the greatest digest), a null key not at all; other columns are ignored.
    """
    records, classes = _classes(df, key, text, loaded)
    return records.join(classes, "_digest", "left").select(F.col("_key").alias(key), "canonical", "class_id")


def look_alike_pairs(df: DataFrame, key: str, text: str, loaded: str | None = None) -> DataFrame:
    """Pairs (``<key>_a`` < ``<key>_b``) of records that are equal as seen but not as stored.

    Copies in one stored form make no pair among themselves. Distinct stored forms of a
    class are paired first, and only those pairs are unfolded into records, so what is
    joined grows with the result. All joins are hash partitioned; a heavy class is split by
    the engine's skew join.
    """
    records, classes = _classes(df, key, text, loaded)
    members = materialize(records.join(classes.select("_digest", "class_id"), "_digest").select("_key", "class_id", "_stored"), "look-alikes")
    forms = members.groupBy("class_id", "_stored").agg(F.count("*").alias("_n"))
    mixed = forms.groupBy("class_id").agg(F.count("*").alias("_forms")).filter("_forms > 1").select("class_id")
    varied = materialize(forms.join(mixed, "class_id", "left_semi").select("class_id", "_stored"), "stored-forms")
    pairs = varied.toDF("class_id", "_a").join(varied.toDF("class_id", "_b"), "class_id").filter("_a < _b").drop("class_id")
    one, other = members.select(F.col("_key").alias("ka"), F.col("_stored").alias("_a")), members.select(F.col("_key").alias("kb"), F.col("_stored").alias("_b"))
    return pairs.join(one, "_a").join(other, "_b").select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
