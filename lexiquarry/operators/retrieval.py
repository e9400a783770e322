"""Boolean and ranked retrieval on an index."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions.analysis import analyze, normalize, split_words
from lexiquarry.operators.index import Index
from lexiquarry.plans.query_parser import And, Literal, Near, Or, Phrase, QueryError, Wildcard, Word, parse_tree
from lexiquarry.workspace import materialize

SCHEMES = ("default", "tfidf", "okapi", "wacky", "bm25", "plain")


# Wildcards


def wildcard_condition(term: Column, pattern: str) -> Column:
    """Whether an unstemmed term fits a pattern with ``*``; for one inner ``*`` beginning and end may overlap."""
    pattern = pattern.lower()
    parts = pattern.split("*")
    inner = [p for p in parts if p]
    if not inner:
        return F.lit(True)
    if len(parts) == 2:
        head, tail = parts
        ends = [F.startswith(term, F.lit(head))] * bool(head) + [F.endswith(term, F.lit(tail))] * bool(tail)
        return reduce(Column.__and__, ends)
    if len(inner) == 1 and not parts[0] and not parts[-1]:
        return F.contains(term, F.lit(inner[0]))
    return term.rlike("^" + ".*".join(re.escape(p) for p in parts) + "$")


def expand_wildcard(index: Index, pattern: str) -> DataFrame:
    """(norm, term): unstemmed terms that fit, and the index terms they became."""
    return index.norms.filter(wildcard_condition(F.col("norm"), pattern))


def expand_by_grams(index: Index, pattern: str) -> DataFrame:
    """(term): the same through the k-gram table: terms with all grams of the pattern, then checked. ASCII terms only."""
    padded = f"${pattern.lower()}$"
    wanted = set()
    for part in padded.split("*"):
        size = min(3, len(part))
        wanted |= {part[i : i + size] for i in range(len(part) - size + 1)} - {"", "$"}
    grams = index.kgrams
    if not wanted:
        return grams.select("term").distinct()
    hits = grams.filter(F.col("gram").isin(sorted(wanted))).groupBy("term").agg(F.count("*").alias("hits"))
    return hits.filter((F.col("hits") == len(wanted)) & wildcard_condition(F.col("term"), pattern)).select("term")


# Boolean


class _Leaves:
    """The index terms and wildcards that a query asks for, numbered."""

    def __init__(self, stemmer: str):
        self.stemmer = stemmer
        self.numbers: dict[str | Wildcard, int] = {}
        self.with_positions: set[int] = set()

    def of(self, key: str | Wildcard) -> int:
        return self.numbers.setdefault(key, len(self.numbers))

    def flags(self, atom: Word | Wildcard, negated: bool) -> Column | None:
        """All terms of a positive word are required, any of a negated one excludes. None for a word without terms."""
        if isinstance(atom, Wildcard):
            return F.col(f"_f{self.of(atom)}")
        flags = [F.col(f"_f{self.of(t)}") for t in analyze(atom.text, self.stemmer)]
        return reduce(Column.__or__ if negated else Column.__and__, flags) if flags else None

    def positions(self, atom: Word | Wildcard) -> Column | None:
        """Positions of a word of a phrase: of the first of its terms."""
        if isinstance(atom, Word):
            found = analyze(atom.text, self.stemmer)
            if not found:
                return None
            atom = found[0]
        number = self.of(atom)
        self.with_positions.add(number)
        return F.col(f"_p{number}")

    def condition(self, atom, negated: bool = False) -> Column:
        if isinstance(atom, Phrase):
            lists = [self.positions(w) for w in atom.words]
            if any(x is None for x in lists):
                return F.lit(False)
            here = lists[0]
            for following in lists[1:]:
                here = F.array_intersect(F.transform(here, lambda p: p + 1), following)
            return F.size(here) > 0
        if isinstance(atom, Near):
            a, b = self.positions(atom.first), self.positions(atom.second)
            if a is None or b is None:
                return F.lit(False)
            return _follows(a, b, atom.distance)
        flag = self.flags(atom, negated)
        return F.lit(False) if flag is None else flag


def _follows(a: Column, b: Column, distance: int) -> Column:
    """Whether a position of ``b`` comes 1 to ``distance`` after one of ``a``: one pass over both, merged; of equal ones b's comes first."""
    merged = F.array_sort(F.concat(F.transform(a, lambda x: x.cast("long") * 2 + 1), F.transform(b, lambda y: y.cast("long") * 2)))
    start = F.struct(F.lit(-(1 << 40)).alias("last"), F.lit(False).alias("met"))

    def step(state: Column, x: Column) -> Column:
        own = x % 2 == 1
        place = F.shiftright(x, 1)
        return F.struct(F.when(own, place).otherwise(state["last"]).alias("last"), (state["met"] | (~own & (place - state["last"] <= distance))).alias("met"))

    return F.aggregate(merged, start, step, lambda state: state["met"])


def _conditions(leaves: _Leaves, node: Or | And | Literal) -> tuple[Column, Column]:
    """Whether a part of a query is met, and whether it is met by a clause with a positive literal."""
    if isinstance(node, Literal):
        met = leaves.condition(node.atom, node.negated)
        return (~met, F.lit(False)) if node.negated else (met, met)
    each = [_conditions(leaves, item) for item in node.items]
    met, positive = ([x[i] for x in each] for i in (0, 1))
    if isinstance(node, Or):
        return reduce(Column.__or__, met), reduce(Column.__or__, positive)
    return reduce(Column.__and__, met), reduce(Column.__and__, met) & reduce(Column.__or__, positive)


def search_boolean(index: Index, query: str) -> DataFrame:
    """(doc_id, file_name) of the documents that satisfy a query.

    A clause without a positive literal is empty, as is one with an unknown positive term.
    NEAR is ordered: 1 to k positions from the first to the second. The tree of the query is
    one condition, as long as the query. One scan of the postings of all terms asked for and
    one shuffle on the document, whatever the clauses.
    """
    leaves = _Leaves(index.stemmer)
    tree = parse_tree(query)
    condition = _conditions(leaves, tree)[1] if tree.items else None
    names = index.forward.select("doc_id", "file_name")
    if condition is None or not leaves.numbers:
        return names.limit(0)
    hits = _leaf_postings(index, leaves)
    flags = [F.max(F.col("_leaf") == n).alias(f"_f{n}") for n in leaves.numbers.values()]
    at = [
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_leaf") == n, F.col("positions"))))).alias(f"_p{n}") for n in sorted(leaves.with_positions)
    ]
    return hits.groupBy("doc_id").agg(*flags, *at).filter(condition).select("doc_id").join(names, "doc_id")


def _leaf_postings(index: Index, leaves: _Leaves) -> DataFrame:
    """(doc_id, _leaf, positions): postings of the plain terms by a pushed-down filter, of the wildcards by a join with their expansions."""
    columns = ["doc_id", "_leaf", *["positions"] * bool(leaves.with_positions)]
    words = {t: n for t, n in leaves.numbers.items() if isinstance(t, str)}
    parts = []
    if words:
        number = F.create_map(*[x for t, n in words.items() for x in (F.lit(t), F.lit(n))])
        parts.append(index.postings.filter(F.col("term").isin(list(words))).withColumn("_leaf", number[F.col("term")]).select(columns))
    for wildcard, n in leaves.numbers.items():
        if isinstance(wildcard, Wildcard):
            fitting = expand_wildcard(index, wildcard.pattern).select("term").distinct()
            parts.append(index.postings.join(fitting, "term", "left_semi").withColumn("_leaf", F.lit(n)).select(columns))
    return reduce(DataFrame.unionByName, parts)


# Ranked


def query_weight(scheme: str, n: Column, df: Column, textbook: bool = False) -> Column:
    """Weight of a term in the query; ``textbook``: idf from the real ratio N / df for tfidf, which else is a whole number."""
    if scheme == "default":
        return F.log(1 + n / df)
    if scheme == "tfidf":
        return F.log(n / df) if textbook else F.log(F.floor(n / df))
    if scheme == "okapi":
        return F.greatest(F.lit(0.1), F.log((n - df + 0.5) / (df + 0.5)))
    if scheme == "wacky":
        return F.when(df >= n, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log((n - df) / df)))
    if scheme == "bm25":
        return F.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.lit(1.0)


def document_weight(scheme: str, tf: Column, avg_tftd: Column, length: Column, average: float, k1: float = 1.2, b: float = 0.75) -> Column:
    if scheme == "default":
        return 1 + F.log(tf)
    if scheme == "tfidf":
        return tf.cast("double")
    if scheme == "okapi":
        return F.lit(2.2) * tf
    if scheme == "wacky":
        return (1 + F.log(tf)) / (1 + F.log(avg_tftd))
    if scheme == "bm25":
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(average or 1.0)))
    return F.lit(1.0)


def normalizer(scheme: str) -> Column:
    if scheme in ("default", "tfidf"):
        return F.col("l_d")
    return F.lit(1.0) if scheme in ("okapi", "bm25") else F.sqrt("byte_size")


def _bag(tree: Or) -> list[Literal]:
    if len(tree.items) > 1:
        raise QueryError("Invalid Query")
    return [x for clause in tree.items for item in clause.items for x in ([item] if isinstance(item, Literal) else _bag(item))]


def query_terms(index: Index, query: str, kgram: bool = True) -> tuple[list[str], list[str]]:
    """Index terms of a ranked query, repeated as often as they are asked for, and its wildcards. Only a bag of words is valid."""
    literals = _bag(parse_tree(query))
    if any(x.negated or isinstance(x.atom, (Phrase, Near)) for x in literals):
        raise QueryError("Invalid Query")
    words, wild = [], []
    for literal in literals:
        if isinstance(literal.atom, Wildcard):
            wild += [literal.atom.pattern] * kgram
        else:
            words += analyze(literal.atom.text, index.stemmer)
    return words, wild


def scores(index: Index, queries: DataFrame, scheme: str = "default", textbook: bool = False, decimals: int = 6, only: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all documents that the queries (query_id, term) find; a repeated term counts again.

    Unknown terms add nothing; documents with a sum of 0 aren't found. The postings hold
    what the weights need of a document, so the only large shuffle is of the sums. Queries
    join the postings on the term, where the engine splits heavy terms; weighted queries
    are broadcast by it if they turn out small. ``only``: all terms of the queries, if they
    are few and known; scans are then restricted to them.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}")
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("_times"))
    n = F.lit(float(index.n_docs()))
    vocab, postings = index.vocab, index.postings
    if only is not None:
        vocab, postings = (t.filter(F.col("term").isin(only)) for t in (vocab, postings))
    weighted = asked.join(vocab, "term").withColumn("_wqt", F.col("_times") * query_weight(scheme, n, F.col("df"), textbook)).select("query_id", "term", "_wqt")
    wdt = document_weight(scheme, F.col("tf"), F.col("avg_tftd"), F.col("doc_length"), index.settings["avg_doc_length"])
    hits = postings.select("term", "doc_id", wdt.alias("_wdt"), normalizer(scheme).alias("_norm")).join(weighted, "term")
    sums = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("_wqt") * F.col("_wdt")).alias("_sum"), F.max("_norm").alias("_norm")).filter("_sum > 0")
    return sums.select("query_id", "doc_id", F.round(F.col("_sum") / F.col("_norm"), decimals).alias("score"))


def rank(
    index: Index, queries: DataFrame, scheme: str = "default", k: int | None = 10, textbook: bool = False, decimals: int = 6, only: list[str] | None = None, counted: bool = False
) -> DataFrame:
    """(query_id, rank, doc_id, file_name, score): top k of each query; see :func:`scores`.

    Ranked on the score rounded to ``decimals``, of equals the lesser doc_id first. The best
    k of each query are taken before and after the last shuffle; names are joined to those
    alone. k None: all, numbered over range partitions. ``counted`` adds ``matches``, how
    many documents the query finds; the scores are then written once and read twice.
    """
    scored = scores(index, queries, scheme, textbook, decimals, only)
    if counted:
        scored = materialize(scored, "scores")
    if k is None:
        ranked = _numbered(scored)
    else:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = ranked.join(index.forward.select("doc_id", "file_name"), "doc_id").select("query_id", "rank", "doc_id", "file_name", "score")
    return out.join(scored.groupBy("query_id").agg(F.count("*").alias("matches")), "query_id") if counted else out


def _numbered(scored: DataFrame) -> DataFrame:
    """Add ``rank`` within each query without bringing a query's rows into one task: its rows before each partition are counted."""
    ordered = scored.repartitionByRange("query_id", F.desc("score"), "doc_id").sortWithinPartitions("query_id", F.desc("score"), "doc_id")
    placed = materialize(ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranked")
    parts = placed.groupBy("query_id", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("query_id", "_part", (F.col("_first") - F.coalesce(before, F.lit(0)) - 1).alias("_start"))
    return placed.join(starts, ["query_id", "_part"]).select("query_id", "doc_id", "score", (F.col("_row") - F.col("_start")).cast("int").alias("rank"))


def _asked(index: Index, query: str, kgram: bool) -> tuple[DataFrame, list[str] | None]:
    """(query_id, term) of one query with its wildcards expanded, and its terms if it has none."""
    words, wild = query_terms(index, query, kgram)
    asked = index.spark.createDataFrame([(0, w) for w in words], "query_id int, term string")
    for pattern in wild:
        asked = asked.unionByName(expand_wildcard(index, pattern).select(F.lit(0).alias("query_id"), "term"))
    return asked, None if wild else sorted(set(words))


def search_ranked(
    index: Index, query: str, scheme: str = "default", k: int | None = 10, kgram: bool = True, textbook: bool = False, counted: bool = False
) -> DataFrame:
    """(rank, doc_id, file_name, score) of one query, with ``counted`` also matches. Each expansion of a wildcard counts as a term of its own."""
    asked, only = _asked(index, query, kgram)
    return rank(index, asked, scheme, k, textbook, only=only, counted=counted).drop("query_id")


def count_ranked(index: Index, query: str, scheme: str = "default") -> int:
    """How many documents a ranked query finds."""
    asked, only = _asked(index, query, True)
    return scores(index, asked, scheme, only=only).count()


def batch_terms(index: Index, queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term) of many plain queries (query_id, <text>) at once, by the analyzer of the index."""
    from lexiquarry.functions.analysis import terms

    return terms(queries.select(F.col("query_id").alias("doc_id"), F.col(text).alias("body")), "body", index.stemmer).select(F.col("doc_id").alias("query_id"), "term")


__all__ = [
    "SCHEMES", "batch_terms", "count_ranked", "expand_by_grams", "expand_wildcard", "normalize", "rank", "search_boolean", "search_ranked", "split_words", "wildcard_condition",
]
