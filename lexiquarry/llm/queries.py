"""Queries of the training-data problems, with SQL where DuckDB can express the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import canonical, distinctive, leakage, near_duplicates, seen, subjects, term_counts, tokenizer
from lexiquarry.llm.record_terms import record_terms
from lexiquarry.workspace import materialize, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Problem 1


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.look_alike_pairs(_table(spark, sf_dir, "articles"), "doc_id", "body", "loaded_at")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_forms(_table(spark, sf_dir, "articles"), "doc_id", "body", "loaded_at")


# Problem 3


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(record_terms(_table(spark, sf_dir, "postings")), "record-terms")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This query's weight, tf * ln(N / n), is the sum of the operator's residual and the expectation it was taken from, times tf."""
    scored = distinctive.residual_idf(_pairs(spark, sf_dir)).filter("n > 1")
    return distinctive.most_characteristic(scored, "weight").select("doc_id", "term")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive.residual_idf(_pairs(spark, sf_dir))
    return scored.select("doc_id", "term", "tf", "n", "cf", F.round("residual", 6).alias("residual"), "score")


def p3_characteristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.most_characteristic(distinctive.residual_idf(_pairs(spark, sf_dir)))


# Problem 4


def _similar(spark: SparkSession, sf_dir: str, **setting) -> tuple[DataFrame, DataFrame]:
    """Articles with a body, each once, by title and body."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "articles"), "doc_id", ["title", "body"], loaded="loaded_at", required="body", **setting)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.record_pairs(*_similar(spark, sf_dir, width=3, limit=near_duplicates.Threshold(3, 5)), "doc_id")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual setting: five words, similarity 0.8."""
    return near_duplicates.record_links(*_similar(spark, sf_dir), "doc_id")


# Problem 5


def _store(spark: SparkSession, sf_dir: str) -> term_counts.TermCounts:
    """The collection as it was before its last articles arrived, then the change to what it is now.

    Late articles are those loaded, or loaded again, in the last tenth of the days. Before
    it, new ones stood under a provisional id (deleted by the change; the article is added),
    and those loaded again held each term once more (changed). Terms of no article count as
    they are. The change is applied as signed deltas.
    """
    pairs = _pairs(spark, sf_dir)
    articles = _table(spark, sf_dir, "articles").select(F.col("doc_id").alias("id"), "loaded_at").dropna()
    days = articles.agg(F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b")).select(F.col("b") - (F.col("b") - F.col("a")) / 10).first()[0]
    times = articles.groupBy("id").agg(F.min("loaded_at").alias("first"), F.max("loaded_at").alias("last"))
    late = times.filter(F.col("last") >= F.lit(days)).select("id", (F.col("first") >= F.lit(days)).alias("new"))
    marked = materialize(pairs.join(late, F.col("doc_id") == F.col("id"), "left").select("doc_id", "term", "tf", "new"), "arrived")
    before = marked.select(
        "term", F.when(F.col("new"), -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(~F.col("new"), F.col("tf") + 1).otherwise(F.col("tf")).alias("tf")
    )
    store = term_counts.TermCounts(spark, new_path(spark, "term-counts"))
    store.apply(before)
    now = marked.filter("new IS NOT NULL")
    store.apply(now.select("term", "doc_id", "tf"), whole=False, deleted=now.filter("new").select((-F.col("doc_id") - 1).alias("doc_id")))
    return store


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return term_counts.marked(store.counts(), store.n_records())


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).counts()


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after three changes: the articles with a title, each term counted once too often in each; then the
    whole collection as it is, which changes those and adds the rest; then the articles without a title deleted."""
    pairs = _pairs(spark, sf_dir)
    articles = canonical.once(_table(spark, sf_dir, "articles"), "doc_id", ["title"], "loaded_at")
    titled = articles.filter("title IS NOT NULL").select("doc_id")
    store = term_counts.TermCounts(spark, new_path(spark, "term-counts"))
    store.apply(materialize(pairs.join(titled, "doc_id", "left_semi").select("term", "doc_id", (F.col("tf") + 1).alias("tf")), "titled"))
    store.apply(pairs)
    store.apply(pairs.limit(0), whole=False, deleted=articles.filter("title IS NULL").select("doc_id"))
    return store.counts()


# Problem 6


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.decode(p6_ids(spark, sf_dir), "doc_id")


# Problem 7


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.occurrences(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_occurrences(spark, sf_dir), leakage.item_phrases(_table(spark, sf_dir, "benchmark")))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(_occurrences(spark, sf_dir))


# Problem 8


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(*(_table(spark, sf_dir, t) for t in ("documents", "labels", "subjects")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents, and their mean share of words."""
    found = p8_subjects(spark, sf_dir)
    return found.groupBy("subject").agg(F.count("*").alias("n_docs"), F.round(F.avg("share"), 6).alias("mean_share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p3_characteristic": p3_characteristic,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
    "p5_changes": p5_changes,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p8_found": p8_found,
    "p8_subjects": p8_subjects,
    "p8_composition": p8_composition,
}


def _sql_class(java: str) -> str:
    """A character class of :mod:`seen` in the regex dialect of DuckDB."""
    import re

    return re.sub(r"\\u([0-9a-f]{4})", lambda m: f"\\x{{{m[1].upper()}}}", java)


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLANK = f"[{_sql_class(seen.BLANK_CLASS)}{''.join(f'\\x{{{a:X}}}-\\x{{{b:X}}}' for a, b in seen.BLANK_HIGH)}]+"


def _form(column: str) -> str:
    """A column as seen, but for separate accents."""
    fold = f"regexp_replace(translate({column}, {_sql_text(seen._FROM)}, {_sql_text(seen._TO)}), {_sql_text(_BLANK)}, '', 'g')"
    return f"nullif(trim(regexp_replace({fold}, {_sql_text('[' + _sql_class(seen.SPACE_CLASS) + ']+')}, ' ', 'g'), ' '), '')"


def _sql_words(column: str) -> str:
    return f"regexp_extract_all(lower(nfc_normalize({_form(column)})), '[\\p{{L}}\\p{{N}}]+')"


_MAPPED = f"""
WITH once AS (SELECT doc_id, arg_max(body, loaded_at) AS body FROM (SELECT * FROM articles WHERE body IS NOT NULL) WHERE doc_id IS NOT NULL GROUP BY doc_id),
mapped AS (SELECT doc_id, body, {_form('body')} AS form FROM once),
keyed AS (SELECT doc_id, body, form, nfc_normalize(form) AS k FROM mapped WHERE form IS NOT NULL)
"""
_PAIRS = """
WITH occ AS (SELECT DISTINCT term, m_doc_id, pos FROM (SELECT term, m_doc_id, unnest(m_positions) AS pos FROM postings)
             WHERE term IS NOT NULL AND m_doc_id IS NOT NULL AND pos IS NOT NULL),
pairs AS (SELECT term, m_doc_id AS doc_id, count(*) AS tf FROM occ GROUP BY ALL),
stats AS (SELECT term, count(*) AS n, CAST(sum(tf) AS BIGINT) AS cf FROM pairs GROUP BY term),
total AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n_all FROM pairs)
"""
_SCORED = f"""{_PAIRS},
scored AS (SELECT p.doc_id, p.term, p.tf, s.n, s.cf, ln(n_all / s.n) AS observed, -ln(1.0 - exp(-s.cf / n_all)) AS expected
           FROM pairs p JOIN stats s USING (term), total)
"""
_P4 = (
    "WITH once AS (SELECT doc_id, arg_max(struct_pack(title := title, body := body), loaded_at) AS r FROM articles WHERE doc_id IS NOT NULL GROUP BY doc_id),"
    "joined AS (SELECT doc_id, coalesce(r.title, '') || ' ' || r.body AS t FROM once WHERE {form} IS NOT NULL),"
    "worded AS MATERIALIZED (SELECT doc_id, {words} AS w FROM joined),"
).format(form=_form("r.body").replace("{", "{{").replace("}", "}}"), words=_sql_words("t").replace("{", "{{").replace("}", "}}")) + """
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width} + 2)) AS i FROM worded)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS MATERIALIZED (SELECT doc_id_a, doc_id_b FROM common JOIN sizes x ON x.doc_id = doc_id_a JOIN sizes y ON y.doc_id = doc_id_b WHERE c * {under} >= (x.n + y.n - c) * {over})
"""
_P7 = f"""
WITH doc_words AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
item_words AS (SELECT item_id, {_sql_words('text')} AS w FROM benchmark),
doc_runs AS (SELECT doc_id, i - 1 AS word_no, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words)),
item_runs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words)),
places AS MATERIALIZED (SELECT doc_id, item_id, word_no FROM doc_runs JOIN item_runs USING (s))
"""
SQL = {
    "p1_found": f"""{_MAPPED}
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM keyed a JOIN keyed b ON a.k = b.k AND a.doc_id < b.doc_id AND a.body <> b.body
""",
    "p1_forms": f"""{_MAPPED},
classes AS (SELECT k, first(form ORDER BY strlen(form), form) AS canonical, min(doc_id) AS class_id FROM keyed GROUP BY k)
SELECT a.doc_id, c.canonical, c.class_id
FROM (SELECT DISTINCT doc_id FROM articles WHERE doc_id IS NOT NULL) a LEFT JOIN keyed USING (doc_id) LEFT JOIN classes c USING (k)
""",
    "p3_found": f"""{_SCORED}
SELECT doc_id, first(term ORDER BY round(tf * observed, 6) DESC, term) AS term FROM scored WHERE n > 1 GROUP BY doc_id
""",
    "p3_scores": f"""{_SCORED}
SELECT doc_id, term, tf, n, cf, round(observed - expected, 6) + 0.0 AS residual, round(tf * (observed - expected), 6) + 0.0 AS score FROM scored
""",
    "p3_characteristic": f"""{_SCORED},
rounded AS (SELECT doc_id, term, round(tf * (observed - expected), 6) AS score FROM scored)
SELECT doc_id, first(term ORDER BY score DESC, term) AS term, max(score) AS score FROM rounded GROUP BY doc_id
""",
    "p4_found": _P4.format(width=3, over=3, under=5)
    + "SELECT doc_id_a, doc_id_b FROM linked",
    "p4_links": _P4.format(width=5, over=4, under=5)
    + """, classes AS (SELECT set_id, min(doc_id) AS class_id FROM (SELECT doc_id, list_sort(list(s)) AS set_id FROM shingles GROUP BY doc_id) GROUP BY set_id),
member AS (SELECT doc_id, class_id FROM (SELECT doc_id, list_sort(list(s)) AS set_id FROM shingles GROUP BY doc_id) JOIN classes USING (set_id)),
ends AS (SELECT doc_id_a AS a, doc_id_b AS b FROM linked UNION ALL SELECT doc_id_b, doc_id_a FROM linked),
far AS (SELECT x.class_id, count(DISTINCT y.class_id) AS n FROM ends JOIN member x ON x.doc_id = a JOIN member y ON y.doc_id = b WHERE x.class_id <> y.class_id GROUP BY x.class_id)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM member LEFT JOIN far USING (class_id)""",
    "p5_found": f"""{_PAIRS}
SELECT term, 'rare' AS mark FROM stats WHERE n < 3
UNION ALL SELECT term, 'common' FROM stats, total WHERE n > 0.75 * n_all
""",
    "p5_counts": f"{_PAIRS} SELECT term, cf AS occurrences, n AS records FROM stats",
    "p5_changes": f"""{_PAIRS}
SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM pairs
WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, max(title) AS t FROM articles WHERE doc_id IS NOT NULL GROUP BY doc_id) WHERE t IS NULL)
GROUP BY term
""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": f"{_P7} SELECT DISTINCT doc_id, item_id FROM places",
    "p7_spans": f"""{_P7},
before AS (SELECT doc_id, word_no, lag(word_no) OVER (PARTITION BY doc_id ORDER BY word_no) AS b FROM (SELECT DISTINCT doc_id, word_no FROM places)),
numbered AS (SELECT doc_id, word_no, sum(CASE WHEN b IS NULL OR word_no > b + 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word_no) AS span FROM before)
SELECT doc_id, min(word_no) AS first_word, max(word_no) + 11 AS last_word FROM numbered GROUP BY doc_id, span""",
}
