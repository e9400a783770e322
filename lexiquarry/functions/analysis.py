"""The analyzer: white-space tokens, edge trim, apostrophes, hyphen expansion, lower case, stemming.

Column expressions for documents and the same rules in Python for the few literals of a
query. A position is the index of a raw token, so a token of mere punctuation takes one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions.porter2 import stem, stem_column

#: Unicode white space; the notation is read alike by Java and RE2.
WHITE = r"[\x{9}-\x{D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: What is trimmed from either end of a token: all but letters and ASCII digits.
EDGES = r"^[^\p{L}0-9]+|[^\p{L}0-9]+$"
APOSTROPHES = "['‘’]"

STEMMERS = ("none", "english")

_PY_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def raw_tokens(text: Column) -> Column:
    """ARRAY<STRING> of the raw tokens; null for a null text."""
    return F.filter(F.split(text, WHITE), lambda x: x != "")


def cleaned(raw: Column) -> Column:
    """A raw token trimmed, without apostrophes, inner parentheses as hyphens, in lower case."""
    return F.lower(F.translate(F.regexp_replace(F.regexp_replace(raw, EDGES, ""), APOSTROPHES, ""), "()", "--"))


def expanded(clean: Column) -> Column:
    """ARRAY<STRING>: the hyphen's parts in order and then the joined form, or the token itself; no empty ones."""
    parts = F.when(F.contains(clean, F.lit("-")), F.concat(F.split(clean, "-"), F.array(F.replace(clean, F.lit("-"), F.lit(""))))).otherwise(F.array(clean))
    return F.filter(parts, lambda x: F.trim(x) != "")


def tokens(documents: DataFrame, text: str = "body") -> DataFrame:
    """(doc_id, pos INT, raw): one row per raw token; null and blank texts have none."""
    return documents.select("doc_id", F.posexplode(raw_tokens(F.col(text))).alias("pos", "raw"))


def emitted_terms(text: Column) -> Column:
    """ARRAY<STRUCT<term, pos>> of a text's unstemmed terms in order; empty for a null text."""
    each = F.transform(raw_tokens(text), lambda raw, at: F.transform(expanded(cleaned(raw)), lambda t: F.struct(t.alias("term"), at.alias("pos"))))
    return F.coalesce(F.flatten(each), F.array().cast("array<struct<term:string,pos:int>>"))


def terms(documents: DataFrame, text: str = "body", stemmer: str = "none") -> DataFrame:
    """(doc_id, pos INT, sub INT, norm, term): emitted terms; several can share a position. All in one narrow stage."""
    if stemmer not in STEMMERS:
        raise ValueError(f"stemmer must be one of {STEMMERS}")
    emitted = tokens(documents, text).select("doc_id", "pos", F.posexplode(expanded(cleaned(F.col("raw")))).alias("sub", "norm"))
    return emitted.withColumn("term", F.col("norm") if stemmer == "none" else stem_column("norm"))


def normalize(token: str) -> list[str]:
    """The normalized terms of one token, as for documents."""
    keep = [i for i, c in enumerate(token) if c.isalpha() or c in "0123456789"]
    clean = token[keep[0] : keep[-1] + 1] if keep else ""
    clean = re.sub(APOSTROPHES, "", clean).translate(str.maketrans("()", "--")).lower()
    parts = [*clean.split("-"), clean.replace("-", "")] if "-" in clean else [clean]
    return [p for p in parts if p.strip()]


def analyze(token: str, stemmer: str = "none") -> list[str]:
    """The index terms of one token."""
    return [stem(t) if stemmer == "english" else t for t in normalize(token)]


def split_words(text: str) -> list[str]:
    return [w for w in _PY_WHITE.split(text) if w]
