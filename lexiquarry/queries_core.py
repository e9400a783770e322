"""Queries of the search engine's own operators over the ``documents`` table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import analysis
from lexiquarry.operators import retrieval
from lexiquarry.operators.classify import Classifier
from lexiquarry.operators.index import Index
from lexiquarry.workspace import new_path

#: Languages that serve as classes; documents in other ones, or in none, are to be classified.
CLASSES = ("de", "es", "fr")
PLACE = "ashbrook"


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a collection of the engine."""
    lang = F.lower(F.substring("lang", 1, 2))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_name"), F.col("text").alias("body"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("byte_size"), F.when(lang.isin(*CLASSES), lang).alias("class"),
    )


_indexes: dict[tuple[str, str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str, stemmer: str = "none") -> Index:
    """The index of a table, built once an application."""
    key = (spark.sparkContext.applicationId, sf_dir, stemmer)
    if key not in _indexes:
        _indexes[key] = Index.build(collection(spark, sf_dir), new_path(spark, "index"), stemmer)
    return _indexes[key]


def _on_index(run: Callable[[Index], DataFrame], stemmer: str = "none") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(index_of(spark, sf_dir, stemmer))


def _value(index: Index, name: str, value: int | bool) -> DataFrame:
    return index.spark.createDataFrame([(value,)], f"{name} {'boolean' if isinstance(value, bool) else 'long'}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_W, _E, _A = (x.replace("'", "''") for x in (analysis.WHITE, analysis.EDGES, analysis.APOSTROPHES))
_EMITTED = f"""
WITH raw AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS raw, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)),
clean AS MATERIALIZED (
  SELECT doc_id, pos, raw, lower(translate(regexp_replace(regexp_replace(raw, '{_E}', '', 'g'), '{_A}', '', 'g'), '()', '--')) AS c FROM raw),
parts AS MATERIALIZED (
  SELECT doc_id, pos, c, list_filter(CASE WHEN contains(c, '-') THEN list_concat(string_split(c, '-'), [replace(c, '-', '')]) ELSE [c] END, lambda x: trim(x) <> '') AS p FROM clean),
emitted AS MATERIALIZED (SELECT doc_id, pos, unnest(p) AS term, CAST(generate_subscripts(p, 1) - 1 AS INT) AS sub FROM parts)"""
_POSTINGS = f"""{_EMITTED},
counted AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf_emit, count(DISTINCT pos) AS tf, 1 + ln(count(*)) AS w FROM emitted GROUP BY ALL),
per_doc AS MATERIALIZED (SELECT doc_id, sqrt(sum(w * w)) AS l_d, count(*) AS doc_length, CAST(sum(tf_emit) AS DOUBLE) AS n_emit FROM counted GROUP BY doc_id),
docs AS MATERIALIZED (SELECT doc_id, 'doc' || doc_id AS file_name, coalesce(strlen(text), 0) AS byte_size,
  CASE WHEN lower(left(lang, 2)) IN ('de', 'es', 'fr') THEN lower(left(lang, 2)) END AS class FROM documents),
stats AS MATERIALIZED (SELECT doc_id, file_name, class, byte_size, coalesce(l_d, 0) AS l_d, coalesce(doc_length, 0) AS doc_length, n_emit / doc_length AS avg_tftd
  FROM docs LEFT JOIN per_doc USING (doc_id)),
vocab AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counted GROUP BY term),
total AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs)"""


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# Analysis

_add("tokenize", lambda s, d: analysis.tokens(collection(s, d)), f"{_EMITTED} SELECT doc_id, pos, raw FROM raw")
_add(
    "normalize_terms",
    lambda s, d: analysis.terms(collection(s, d)).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")),
    f"{_EMITTED} SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM emitted GROUP BY ALL",
)
_add(
    "hyphen_expand",
    lambda s, d: analysis.terms(collection(s, d)).filter("sub > 0").select("doc_id", "pos", "sub", "term"),
    f"{_EMITTED} SELECT doc_id, pos, sub, term FROM emitted WHERE sub > 0",
)

# Index

_add("postings_tf", _on_index(lambda i: i.postings.select("term", "doc_id", "tf_emit", "tf")), f"{_POSTINGS} SELECT term, doc_id, CAST(tf_emit AS INT) AS tf_emit, CAST(tf AS INT) AS tf FROM counted")
_add("positions", _on_index(lambda i: i.postings.select("term", "doc_id", F.explode("positions").alias("pos"))), f"{_EMITTED} SELECT DISTINCT term, doc_id, pos FROM emitted")
_add(
    "stored_weights",
    _on_index(lambda i: i.postings.select("term", "doc_id", *[F.round(w, 6).alias(w) for w in ("w_default", "w_tfidf", "w_okapi", "w_wacky")])),
    f"""{_POSTINGS}
SELECT term, doc_id, round(w, 6) AS w_default, round(ln(doc_length / tf_emit), 6) + 0.0 AS w_tfidf, CAST(round(2.2 * tf_emit, 6) AS DOUBLE) AS w_okapi, round(w / (1 + ln(n_emit / doc_length)), 6) AS w_wacky
FROM counted JOIN per_doc USING (doc_id)""",
)
_add(
    "doc_stats",
    _on_index(lambda i: i.doc_stats.select("doc_id", "file_name", F.round("l_d", 6).alias("l_d"), "doc_length", "byte_size", F.round("avg_tftd", 6).alias("avg_tftd"))),
    f"{_POSTINGS} SELECT doc_id, file_name, CAST(round(l_d, 6) AS DOUBLE) AS l_d, doc_length, byte_size, round(avg_tftd, 6) AS avg_tftd FROM stats",
)
_add(
    "corpus_stats",
    _on_index(lambda i: i.corpus_stats.select("n_docs", F.round("avg_doc_length", 6).alias("avg_doc_length"))),
    f"{_POSTINGS} SELECT count(*) AS n_docs, round(avg(doc_length), 6) AS avg_doc_length FROM stats",
)
_add("vocab_top30", _on_index(lambda i: i.vocabulary()), f"{_POSTINGS} SELECT term FROM vocab ORDER BY term LIMIT 30")
_add("vocab_size", _on_index(lambda i: _value(i, "n", i.vocabulary_size())), f"{_POSTINGS} SELECT count(*) AS n FROM vocab")
_add("document_frequency", _on_index(lambda i: i.vocab.select("term", "df")), f"{_POSTINGS} SELECT term, df FROM vocab")
_add("collection_frequency", _on_index(lambda i: i.vocab.select("term", "cf")), f"{_POSTINGS} SELECT term, cf FROM vocab")
_add("total_term_frequency", _on_index(lambda i: _value(i, "n", i.total_term_frequency())), f"{_POSTINGS} SELECT CAST(sum(cf) AS BIGINT) AS n FROM vocab")
_add("postings_of_term", _on_index(lambda i: i.postings_of(PLACE, False).select("term", "doc_id", "tf")), f"{_POSTINGS} SELECT term, doc_id, CAST(tf AS INT) AS tf FROM counted WHERE term = '{PLACE}'")
_add(
    "terms_for_document",
    _on_index(lambda i: i.terms_of(i.doc_stats.agg(F.min("doc_id")).first()[0])),
    f"{_POSTINGS} SELECT term FROM counted WHERE doc_id = (SELECT min(doc_id) FROM docs)",
)
_add("contains_term", _on_index(lambda i: _value(i, "there", i.contains(PLACE))), f"{_POSTINGS} SELECT count(*) > 0 AS there FROM vocab WHERE term = '{PLACE}'")
_add(
    "document_weights",
    _on_index(lambda i: i.document_weights(i.doc_stats.agg(F.min("doc_id")).first()[0]).select(*[F.round(c, 6).alias(c) for c in ("avg_doc_length", "l_d", "avg_tftd")], "doc_length", "byte_size")),
    f"""{_POSTINGS} SELECT round((SELECT avg(doc_length) FROM stats), 6) AS avg_doc_length, round(l_d, 6) AS l_d, round(avg_tftd, 6) AS avg_tftd, doc_length, byte_size
FROM stats WHERE doc_id = (SELECT min(doc_id) FROM docs)""",
)
_add("inverted_index", _on_index(lambda i: i.inverted()), f"{_EMITTED} SELECT DISTINCT term, doc_id FROM emitted")

# K-grams and wildcards

_GRAMS = f"""{_EMITTED}, norms AS (SELECT DISTINCT term, '$' || term || '$' AS p FROM emitted WHERE regexp_matches(term, '^[\\x00-\\x7F]+$')),
kgrams AS (SELECT DISTINCT term, unnest(list_transform(range(1, length(p) - k + 2), lambda i: substr(p, CAST(i AS INT), CAST(k AS INT)))) AS gram FROM norms, (SELECT unnest([1, 2, 3]) AS k))"""
_add("kgrams", _on_index(lambda i: i.kgrams), f"{_GRAMS} SELECT gram, term FROM kgrams")
_add("kgram_list", _on_index(lambda i: i.gram_list()), f"{_GRAMS} SELECT DISTINCT gram FROM kgrams")
_add("kgram_terms", _on_index(lambda i: i.terms_of_gram("ell")), f"{_GRAMS} SELECT term FROM kgrams WHERE gram = 'ell'")
for _name, _pattern, _fits in (
    ("wildcard_prefix", "gra*", "starts_with(term, 'gra')"),
    ("wildcard_suffix", "*brook", "ends_with(term, 'brook')"),
    ("wildcard_contains", "*ell*", "contains(term, 'ell')"),
    ("wildcard_middle", "c*n", "starts_with(term, 'c') AND ends_with(term, 'n')"),
    ("wildcard_parts", "c*n*y", "regexp_matches(term, '^c.*n.*y$')"),
):
    _add(_name, _on_index(lambda i, p=_pattern: retrieval.expand_wildcard(i, p).select("term").distinct()), f"{_EMITTED} SELECT DISTINCT term FROM emitted WHERE {_fits}")
    _add(f"{_name}_by_grams", _on_index(lambda i, p=_pattern: retrieval.expand_by_grams(i, p)), f"{_GRAMS} SELECT DISTINCT term FROM kgrams WHERE {_fits}")

# Boolean retrieval

_HAS = "doc_id IN (SELECT doc_id FROM counted WHERE term = '{}')"
_FIND = f"{_POSTINGS} SELECT doc_id, file_name FROM docs WHERE "


def _has(term: str) -> str:
    return _HAS.format(term)


def _phrase(*words: str) -> str:
    joins = "".join(f" JOIN emitted e{i} ON e{i}.doc_id = e0.doc_id AND e{i}.pos = e0.pos + {i} AND e{i}.term = '{w}'" for i, w in enumerate(words[1:], 1))
    return f"doc_id IN (SELECT e0.doc_id FROM emitted e0{joins} WHERE e0.term = '{words[0]}')"


def _near(a: str, k: int, b: str) -> str:
    return f"doc_id IN (SELECT x.doc_id FROM emitted x JOIN emitted y ON x.doc_id = y.doc_id AND y.pos - x.pos BETWEEN 1 AND {k} WHERE x.term = '{a}' AND y.term = '{b}')"


for _name, _query, _where in (
    ("bool_term", "granite", _has("granite")),
    ("bool_and", "the granite", f"{_has('the')} AND {_has('granite')}"),
    ("bool_or", "granite + query", f"{_has('granite')} OR {_has('query')}"),
    ("bool_not", "the -granite", f"{_has('the')} AND NOT {_has('granite')}"),
    ("bool_nested", "the (granite + query (table + report)) -court", f"{_has('the')} AND ({_has('granite')} OR ({_has('query')} AND ({_has('table')} OR {_has('report')}))) AND NOT {_has('court')}"),
    ("bool_hyphen", "long-term", f"{_has('long')} AND {_has('term')} AND {_has('longterm')}"),
    ("bool_not_only", "-granite", "false"),
    ("bool_unknown", "zzzz the", "false"),
    ("phrase2", '"in the"', _phrase("in", "the")),
    ("phrase3", '"it is the"', _phrase("it", "is", "the")),
    ("not_phrase", 'the -"in the"', f"{_has('the')} AND NOT {_phrase('in', 'the')}"),
    ("near_k", "granite NEAR/6 in", _near("granite", 6, "in")),
    ("near_and", "granite NEAR/6 in report", f"{_near('granite', 6, 'in')} AND {_has('report')}"),
    ("bool_wildcard", "gran* -*brook", "doc_id IN (SELECT doc_id FROM counted WHERE starts_with(term, 'gran')) AND NOT doc_id IN (SELECT doc_id FROM counted WHERE ends_with(term, 'brook'))"),
):
    _add(_name, _on_index(lambda i, q=_query: retrieval.search_boolean(i, q)), _FIND + _where)

# Ranked retrieval

_WQT = {
    "default": "ln(1 + n / df)",
    "tfidf": "ln(floor(n / df))",
    "okapi": "greatest(0.1, ln((n - df + 0.5) / (df + 0.5)))",
    "wacky": "CASE WHEN df >= n THEN 0.0 ELSE greatest(0.0, ln((n - df) / df)) END",
    "bm25": "ln(1 + (n - df + 0.5) / (df + 0.5))",
    "plain": "1.0",
}
_WDT = {
    "default": "1 + ln(tf)",
    "tfidf": "tf",
    "okapi": "2.2 * tf",
    "wacky": "(1 + ln(tf)) / (1 + ln(avg_tftd))",
    "bm25": "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_length / (SELECT avg(doc_length) FROM stats)))",
    "plain": "1.0",
}
_LD = {"default": "l_d", "tfidf": "l_d", "okapi": "1.0", "bm25": "1.0", "wacky": "sqrt(byte_size)", "plain": "sqrt(byte_size)"}


def _rank_sql(scheme: str, asked: str, columns: str = "rank, doc_id, file_name, score", k: int = 10) -> str:
    return f"""{_POSTINGS}, asked AS ({asked}),
sums AS (SELECT query_id, doc_id, file_name, sum(({_WQT[scheme]}) * ({_WDT[scheme]})) AS a, any_value({_LD[scheme]}) AS ld
  FROM asked JOIN vocab USING (term) JOIN counted USING (term) JOIN stats USING (doc_id), total GROUP BY ALL),
scored AS (SELECT query_id, doc_id, file_name, round(a / ld, 6) AS score FROM sums WHERE a > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored)
SELECT {columns} FROM ranked WHERE rank <= {k}"""


def _words(*words: str) -> str:
    return f"SELECT 0 AS query_id, unnest([{', '.join(map(repr, words))}]) AS term"


for _scheme in retrieval.SCHEMES:
    _add(f"rank_{_scheme}", _on_index(lambda i, s=_scheme: retrieval.search_ranked(i, "granite in the court", s)), _rank_sql(_scheme, _words("granite", "in", "the", "court")))
_add("rank_duplicate_terms", _on_index(lambda i: retrieval.search_ranked(i, "granite granite court")), _rank_sql("default", _words("granite", "granite", "court")))
_add(
    "rank_wildcard",
    _on_index(lambda i: retrieval.search_ranked(i, "gran* court")),
    _rank_sql("default", "SELECT 0 AS query_id, 'court' AS term UNION ALL SELECT 0, term FROM vocab WHERE starts_with(term, 'gran')"),
)
_add("rank_count", _on_index(lambda i: _value(i, "n", retrieval.count_ranked(i, "granite in the court"))), _rank_sql("default", _words("granite", "in", "the", "court"), "count(*) AS n", 10**9))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as queries, ten best documents each."""
    index = index_of(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.rank(index, retrieval.batch_terms(index, items), "default")


_add(
    "rank_batch",
    _batch,
    _rank_sql("default", "SELECT doc_id AS query_id, term FROM bench_emitted", "query_id, rank, doc_id, file_name, score").replace(
        ", asked AS",
        "".join(
            ", "
            + part.replace("WITH ", "").replace("documents", "(SELECT item_id AS doc_id, text FROM benchmark)").replace("raw AS MATERIALIZED", "bench_raw AS MATERIALIZED")
            .replace("FROM raw)", "FROM bench_raw)").replace("clean AS MATERIALIZED", "bench_clean AS MATERIALIZED").replace("FROM clean)", "FROM bench_clean)")
            .replace("parts AS MATERIALIZED", "bench_parts AS MATERIALIZED").replace("FROM parts)", "FROM bench_parts)").replace("emitted AS MATERIALIZED", "bench_emitted AS MATERIALIZED")
            for part in [_EMITTED.strip()]
        )
        + ", asked AS",
        1,
    ),
)

# Classification

_CLASS = f"""{_POSTINGS},
sizes AS MATERIALIZED (SELECT class, count(*) AS n_c FROM docs WHERE class IS NOT NULL GROUP BY class),
cpost AS MATERIALIZED (SELECT c.term, c.doc_id, c.tf, c.w / s.l_d AS component, s.class FROM counted c JOIN stats s USING (doc_id)),
cterms AS MATERIALIZED (SELECT class, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM cpost WHERE class IS NOT NULL GROUP BY ALL)"""
_MI = f"""{_CLASS},
cells AS (SELECT class, term, CAST(df AS DOUBLE) AS n11, CAST(n_c - df AS DOUBLE) AS n10, CAST(sum(df) OVER (PARTITION BY term) - df AS DOUBLE) AS n01,
  CAST((SELECT sum(n_c) FROM sizes) - n_c - sum(df) OVER (PARTITION BY term) + df AS DOUBLE) AS n00 FROM cterms JOIN sizes USING (class)),
mi AS MATERIALIZED (SELECT class, term, {' + '.join(f'CASE WHEN n{i}{j} > 0 THEN n{i}{j} / (n11+n10+n01+n00) * log2((n11+n10+n01+n00) * n{i}{j} / ((n{i}0 + n{i}1) * (n0{j} + n1{j}))) ELSE 0 END' for i in (0, 1) for j in (0, 1))} AS score FROM cells),
best AS (SELECT term, class, round(score, 9) AS score FROM mi QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(score, 9) DESC, class) = 1),
top AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY score DESC, term) AS INT) AS rank, term, class, score FROM best ORDER BY score DESC, term LIMIT 50)"""
_NB = f"""{_MI},
grid AS (SELECT sizes.class, top.term, coalesce(cf, 0) AS cf FROM sizes, top LEFT JOIN cterms ON cterms.class = sizes.class AND cterms.term = top.term),
ll AS MATERIALIZED (SELECT class, term, log2((cf + 1) / CAST(sum(cf) OVER (PARTITION BY class) + count(*) OVER (PARTITION BY class) AS DOUBLE)) AS v FROM grid),
nb AS MATERIALIZED (SELECT d.doc_id, d.file_name, s.class, round(log2(s.n_c / (SELECT CAST(sum(n_c) AS DOUBLE) FROM sizes)) + coalesce(sum(ll.v), 0), 6) AS score
  FROM docs d, sizes s LEFT JOIN cpost p ON p.doc_id = d.doc_id AND p.term IN (SELECT term FROM top) LEFT JOIN ll ON ll.term = p.term AND ll.class = s.class
  WHERE d.class IS NULL GROUP BY d.doc_id, d.file_name, s.class, s.n_c)"""
_ROCCHIO = f"""{_CLASS},
cent AS MATERIALIZED (SELECT class, term, sum(component) / any_value(n_c) AS component FROM cpost JOIN sizes USING (class) GROUP BY class, term),
cn AS (SELECT class, sum(component * component) AS n FROM cent GROUP BY class),
v AS (SELECT DISTINCT term FROM cent),
dn AS (SELECT doc_id, sum(component * component) AS n FROM cpost JOIN v USING (term) WHERE class IS NULL GROUP BY doc_id),
dots AS (SELECT p.doc_id, c.class, sum(p.component * c.component) AS x FROM cpost p JOIN cent c USING (term) WHERE p.class IS NULL GROUP BY p.doc_id, c.class),
dist AS MATERIALIZED (SELECT d.doc_id, d.file_name, cn.class, sqrt(greatest(0.0, coalesce(dn.n, 0) + cn.n - 2 * coalesce(x, 0))) AS distance
  FROM docs d, cn LEFT JOIN dn ON dn.doc_id = d.doc_id LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.class = cn.class WHERE d.class IS NULL)"""

_add("mi_scores", _on_index(lambda i: Classifier(i).mutual_information().select("class", "term", F.round("score", 9).alias("score"))), f"{_MI} SELECT class, term, round(score, 9) + 0.0 AS score FROM mi")
_add("mi_contingency", _on_index(lambda i: Classifier(i).contingency()), f"{_MI} SELECT class, term, CAST(n11 AS BIGINT) AS n11, CAST(n10 AS BIGINT) AS n10, CAST(n01 AS BIGINT) AS n01, CAST(n00 AS BIGINT) AS n00 FROM cells")
_add("discriminating_vocab", _on_index(lambda i: Classifier(i).discriminating_terms()), f"{_MI} SELECT rank, term, class, score FROM top")
_add("nb_scores", _on_index(lambda i: Classifier(i).bayes_scores().withColumn("score", F.round("score", 6))), f"{_NB} SELECT doc_id, class, score FROM nb")
_add("nb_classify", _on_index(lambda i: Classifier(i).classify_bayes()), f"{_NB} SELECT doc_id, file_name, first(class ORDER BY score DESC, class) AS class FROM nb GROUP BY ALL")
_add(
    "centroids_top30",
    _on_index(lambda i: Classifier(i).centroids(30).withColumn("component", F.round("component", 9))),
    f"{_ROCCHIO} SELECT class, term, round(component, 9) AS component FROM cent QUALIFY row_number() OVER (PARTITION BY class ORDER BY term) <= 30",
)
_add("rocchio_distance", _on_index(lambda i: Classifier(i).distances().withColumn("distance", F.round("distance", 6))), f"{_ROCCHIO} SELECT doc_id, class, round(distance, 6) AS distance FROM dist")
_add("rocchio_classify", _on_index(lambda i: Classifier(i).classify_rocchio()), f"{_ROCCHIO} SELECT doc_id, file_name, first(class ORDER BY round(distance, 9), class) AS class FROM dist GROUP BY ALL")
_add("all_vocab", _on_index(lambda i: Classifier(i).all_vocabulary()), f"{_CLASS} SELECT DISTINCT term FROM cterms")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_default"](spark, sf_dir)
