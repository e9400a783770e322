"""Queries of stemmed search, of collections read from files and streams, of modes and of single documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry import queries_core as core
from lexiquarry.engine import Engine
from lexiquarry.functions.varbyte import decoded_gaps, encoded_gaps
from lexiquarry.operators import retrieval
from lexiquarry.operators.classify import Classifier
from lexiquarry.operators.index import Index
from lexiquarry.sources.call_words import CALL_WORDS, LONGEST, SHORTEST, call_word_documents
from lexiquarry.sources.collections import from_table, read_classes, read_directory
from lexiquarry.streaming.segments import SegmentedIndex, index_stream
from lexiquarry.workspace import new_path, write_new

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _on_stems(run):
    return lambda spark, sf_dir: run(core.index_of(spark, sf_dir, "english"))


# Stemmed search. The stems of these words stand in the SQL as a table; no other word of the collection has one of them.

STEMS = {
    "vote": ("vote", "votes", "voted", "voting"),
    "queri": ("query", "queries", "queried", "querying"),
    "migrat": ("migrate", "migrates", "migrated", "migrating", "migration", "migrations"),
    "elect": ("elect", "elects", "elected", "electing", "election", "elections", "elective"),
    "granit": ("granite", "granites", "granit"),
    "appeal": ("appeal", "appeals", "appealed", "appealing"),
}
_MAP = ", ".join(f"('{norm}', '{stem}')" for stem, norms in STEMS.items() for norm in norms)
_STEMMED = f"{core._POSTINGS}, smap(norm, stem) AS (VALUES {_MAP}), stemmed AS MATERIALIZED (SELECT e.doc_id, e.pos, e.term AS norm, smap.stem AS term FROM emitted e JOIN smap ON e.term = smap.norm)"
_NAMES = f"{_STEMMED} SELECT doc_id, file_name FROM docs WHERE "


def _stem_in(stem: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM stemmed WHERE term = '{stem}')"


_add(
    "stemmed_norms",
    _on_stems(lambda i: i.norms.filter(F.col("norm").isin([n for norms in STEMS.values() for n in norms])).select("norm", "term")),
    f"{_STEMMED} SELECT DISTINCT norm, term FROM stemmed",
)
_add(
    "stemmed_vocab",
    _on_stems(lambda i: i.vocab.filter(F.col("term").isin(list(STEMS))).select("term", "df", "cf")),
    f"{_STEMMED} SELECT term, count(DISTINCT doc_id) AS df, count(DISTINCT (doc_id, pos)) AS cf FROM stemmed GROUP BY term",
)
_add(
    "stemmed_positions",
    _on_stems(lambda i: i.postings.filter(F.col("term").isin(list(STEMS))).select("term", "doc_id", F.explode("positions").alias("pos"))),
    f"{_STEMMED} SELECT DISTINCT term, doc_id, pos FROM stemmed",
)
_add("stemmed_bool", _on_stems(lambda i: retrieval.search_boolean(i, "voting + elections -migrated")), f"{_NAMES} ({_stem_in('vote')}) OR ({_stem_in('elect')} AND NOT {_stem_in('migrat')})")
_add(
    "stemmed_phrase",
    _on_stems(lambda i: retrieval.search_boolean(i, '"the querying"')),
    f"{_NAMES} doc_id IN (SELECT s.doc_id FROM stemmed s JOIN emitted e ON e.doc_id = s.doc_id AND e.pos = s.pos - 1 AND e.term = 'the' WHERE s.term = 'queri')",
)
_add(
    "stemmed_near",
    _on_stems(lambda i: retrieval.search_boolean(i, "granites NEAR/9 in")),
    f"{_NAMES} doc_id IN (SELECT s.doc_id FROM stemmed s JOIN emitted e ON e.doc_id = s.doc_id AND e.pos - s.pos BETWEEN 1 AND 9 AND e.term = 'in' WHERE s.term = 'granit')",
)
_add(
    "stemmed_rank",
    _on_stems(lambda i: retrieval.search_ranked(i, "appealing the elective votes", "okapi").filter("rank > 0")),
    f"""{_STEMMED}, both_kinds AS (SELECT doc_id, pos, term FROM stemmed UNION ALL SELECT doc_id, pos, term FROM emitted WHERE term = 'the'),
tfs AS (SELECT doc_id, term, count(DISTINCT pos) AS tf FROM both_kinds WHERE term IN ('appeal', 'the', 'elect', 'vote') GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
sums AS (SELECT doc_id, round(sum(greatest(0.1, ln((n - df + 0.5) / (df + 0.5))) * 2.2 * tf), 6) AS score FROM tfs JOIN dfs USING (term), total GROUP BY doc_id),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sums)
SELECT rank, doc_id, file_name, score FROM ranked JOIN docs USING (doc_id) WHERE rank <= 10""",
)

# Stemming of single words, as the reference pairs and the analyzer's rules have them

_WORDS = {
    "Swimming,": ("swimming", "swim"), "swam": ("swam", "swam"), "Needlessly": ("needlessly", "needless"), "tEsts": ("tests", "test"), "(Faster)": ("faster", "faster"),
    "f(x)y": ("f x y fxy", "f x y fxi"), "don’t": ("dont", "dont"), "***": ("", ""), "mother-in-law": ("mother in law motherinlaw", "mother in law motherinlaw"),
}


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(token, *(" ".join(found[kind]) for kind in ("normalized", "stemmed"))) for token in _WORDS for found in (Engine.analyze(token),)]
    return spark.createDataFrame(rows, "token string, normalized string, stemmed string")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_add("analyze_token", _analyzed, "SELECT * FROM (VALUES " + ", ".join(f"({_text(t)}, {_text(a)}, {_text(b)})" for t, (a, b) in _WORDS.items()) + ") AS t(token, normalized, stemmed)")

# Collections of files

_FILES = {
    "b.txt": "mike echo\nJuliet victor\n", "a.txt": "", "c.json": '{"title": "Third", "body": " one\\n  two ", "url": "http://x", "more": [1]}', "d.json": '{"title": "Fourth", "body": "kilo"}',
}
_READ = (
    (0, "a.txt", None, "", "", 0), (1, "b.txt", None, "mike echo\nJuliet victor\n", "", 24), (2, "c.json", "Third", "one two ", "http://x", len(_FILES["c.json"])),
    (3, "d.json", "Fourth", "kilo ", None, len(_FILES["d.json"])),
)


def _values(rows, names: str) -> str:
    def show(v) -> str:
        return "NULL" if v is None else _text(v) if isinstance(v, str) else f"CAST({v} AS BIGINT)"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") AS t({names})"


def _directory(spark: SparkSession, files: dict[str, str]) -> str:
    where = new_path(spark, "directory")
    for name, text in files.items():
        write_new(spark, f"{where}/{name}", text)
    return where


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_directory(spark, _directory(spark, _FILES))
    return read.withColumn("title", F.when(F.endswith("file_name", F.lit(".json")), F.col("title")))  # of a text file its path


_add("read_directory", _read, _values(_READ, "doc_id, file_name, title, body, url, byte_size"))


def _class_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {name: _directory(spark, {f"{name}{i}.txt": t for i, t in enumerate(texts)}) for name, texts in (("x", ("alpha",)), ("y", ("bravo", "kilo")), ("open", ("mike",)))}
    return read_classes(spark, {c: places[c] for c in "xy"}, places["open"]).select("doc_id", "file_name", "body", "class")


_add("read_classes", _class_directories, _values([(0, "open0.txt", "mike", None), (1, "x0.txt", "alpha", "x"), (2, "y0.txt", "bravo", "y"), (3, "y1.txt", "kilo", "y")], "doc_id, file_name, body, class"))


def _directory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.build_directory(spark, _directory(spark, _FILES), new_path(spark, "engine"))
    return Engine.open(spark, engine.index.path).search("victor + kilo -mike")


_add("directory_search", _directory_search, _values([(1, "b.txt"), (3, "d.json")], "doc_id, file_name"))

_DRAWN = "CAST(floor((((({0}) % 2147483648 * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648 / 65536) AS BIGINT) % {1}"
_add(
    "call_word_documents",
    lambda s, d: call_word_documents(s, 1000, 7).select("doc_id", "file_name", "body", "byte_size"),
    f"""WITH ids AS (SELECT range AS id, (range + 7 * 1000003) * 16 AS f FROM range(1000)),
lengths AS (SELECT *, {SHORTEST} + {_DRAWN.format('f', LONGEST - SHORTEST + 1)} AS n FROM ids),
words AS (SELECT id, i, [{', '.join(map(repr, CALL_WORDS))}][1 + {_DRAWN.format('f + i', 26)}] AS w FROM (SELECT id, f, unnest(range(1, n + 1)) AS i FROM lengths)),
bodies AS (SELECT id, string_agg(w, chr(10) ORDER BY i) || chr(10) AS body FROM words GROUP BY id)
SELECT id AS doc_id, 'doc' || (id + 1) || '.txt' AS file_name, body, CAST(strlen(body) AS BIGINT) AS byte_size FROM bodies""",
)


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = from_table(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id="item_id")
    engine = Engine.build(items, new_path(spark, "engine"), kgram=False)
    return engine.open_document(items.agg(F.min_by("file_name", "doc_id")).first()[0])


_add("open_document", _opened, "SELECT text AS body FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, each micro-batch a segment."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", F.col("text").alias("body"))
    out = new_path(spark, "segments")
    index_stream(arriving, out, new_path(spark, "stream"), kgram=False, available_now=True).awaitTermination()
    return SegmentedIndex.open(spark, out).vocab


_add("stream_vocab", _streamed, f"{core._POSTINGS} SELECT term, df, cf FROM vocab")

# Status, modes, counts with the ranking, all ranks

_add("kgram_status", core._on_index(Index.kgram_status), f"{core._GRAMS} SELECT true AS enabled, count(DISTINCT gram) AS grams FROM kgrams")
_add("mode_boolean", core._on_index(lambda i: Engine(i).search("granite court")), f"{core._FIND} {core._has('granite')} AND {core._has('court')}")
_add("mode_ranked", core._on_index(lambda i: Engine(i).search("granite court", "ranked", "tfidf", 5)), core._rank_sql("tfidf", core._words("granite", "court"), k=5))
_add("not_near", core._on_index(lambda i: retrieval.search_boolean(i, "granite -granite NEAR/6 in")), f"{core._FIND} {core._has('granite')} AND NOT {core._near('granite', 6, 'in')}")
_add(
    "bool_groups",
    core._on_index(lambda i: retrieval.search_boolean(i, "(the + la) (of + de) (granite + court + query) (in + -report) (a + -table)")),
    f"""{core._FIND} ({core._has('the')} OR {core._has('la')}) AND ({core._has('of')} OR {core._has('de')}) AND ({core._has('granite')} OR {core._has('court')} OR {core._has('query')})
  AND ({core._has('in')} OR NOT {core._has('report')}) AND ({core._has('a')} OR NOT {core._has('table')})""",
)
_ASKED = core._words("granite", "in", "the", "court")
_add("rank_counted", core._on_index(lambda i: retrieval.search_ranked(i, "granite in the court", "okapi", counted=True)), core._rank_sql("okapi", _ASKED, "rank, doc_id, file_name, score, (SELECT count(*) FROM scored) AS matches"))
_add("rank_all", core._on_index(lambda i: retrieval.search_ranked(i, "granite in the court", "bm25", k=None)), core._rank_sql("bm25", _ASKED, k=10**9))

# Variable-byte lists of positions

_BYTES = "CASE WHEN g < 128 THEN printf('%02X', g | 128) WHEN g < 16384 THEN printf('%02X%02X', g // 128, (g % 128) | 128) ELSE printf('%02X%02X%02X', g // 16384, (g // 128) % 128, (g % 128) | 128) END"
_add(
    "varbyte_positions",
    core._on_index(lambda i: i.postings_of("granite").withColumn("data", encoded_gaps("positions")).select("doc_id", F.hex("data").alias("bytes"), (decoded_gaps("data") == F.col("positions")).alias("same"))),
    f"""{core._EMITTED}, gaps AS (SELECT doc_id, pos, pos - coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS g FROM (SELECT DISTINCT doc_id, pos FROM emitted WHERE term = 'granite'))
SELECT doc_id, string_agg({_BYTES}, '' ORDER BY pos) AS bytes, true AS same FROM gaps GROUP BY doc_id""",
)

# One document to classify

_ONE = "file_name = (SELECT file_name FROM docs WHERE doc_id = (SELECT min(doc_id) FROM docs WHERE class IS NULL))"


def _one(run):
    return core._on_index(lambda i: run(Classifier(i), i.forward.filter("class IS NULL").agg(F.min_by("file_name", "doc_id")).first()[0]))


_add("nb_classify_one", _one(lambda c, name: c.classify_bayes(file_name=name)), f"{core._NB} SELECT doc_id, file_name, first(class ORDER BY score DESC, class) AS class FROM nb WHERE {_ONE} GROUP BY ALL")
_add("rocchio_classify_one", _one(lambda c, name: c.classify_rocchio(file_name=name)), f"{core._ROCCHIO} SELECT doc_id, file_name, first(class ORDER BY round(distance, 9), class) AS class FROM dist WHERE {_ONE} GROUP BY ALL")
