"""Generated documents of call words, for trying things out at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The call words of the spelling alphabet.
CALL_WORDS = (
    "alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike",
    "november", "oscar", "papa", "quebec", "romeo", "sierra", "tango", "uniform", "victor", "whiskey", "xray", "yankee", "zulu",
)
SHORTEST, LONGEST = 11, 15  # words of a document

# A linear congruence, so that every row follows from its number alone.
_STEP, _ADD, _RANGE = 1_103_515_245, 12_345, 1 << 31


def _drawn(number, below: int):
    """A whole number below a bound, drawn for a number."""
    mixed = (F.pmod(number, F.lit(_RANGE)) * _STEP + _ADD) % F.lit(_RANGE)
    return F.floor(((mixed * _STEP + _ADD) % F.lit(_RANGE)) / 65_536) % below


def call_word_documents(spark: SparkSession, n: int = 5, seed: int = 0) -> DataFrame:
    """(doc_id, file_name, title, body, url, byte_size): n documents of 11 to 15 call words, one a line; the same for the same seed."""
    first = (F.col("id") + seed * 1_000_003) * 16
    length = _drawn(first, LONGEST - SHORTEST + 1) + SHORTEST
    words = F.transform(F.sequence(F.lit(1).cast("long"), length), lambda i: F.get(F.array(*map(F.lit, CALL_WORDS)), _drawn(first + i, len(CALL_WORDS)).cast("int")))
    name = F.concat(F.lit("doc"), (F.col("id") + 1).cast("string"), F.lit(".txt"))
    documents = spark.range(n).select(F.col("id").alias("doc_id"), name.alias("file_name"), name.alias("title"), F.concat(F.array_join(words, "\n"), F.lit("\n")).alias("body"), F.lit("").alias("url"))
    return documents.withColumn("byte_size", F.octet_length("body").cast("long"))
