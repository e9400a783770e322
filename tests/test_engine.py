import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiquarry import workspace
from lexiquarry.engine import Engine
from lexiquarry.operators.classify import Classifier
from lexiquarry.operators.index import Index, NoGrams, forward_table, normalized_documents
from lexiquarry.operators.retrieval import count_ranked, expand_by_grams, expand_wildcard, rank
from lexiquarry.plans.query_parser import QueryError
from lexiquarry.sources.call_words import CALL_WORDS, call_word_documents
from lexiquarry.sources.collections import read_classes, read_directory
from lexiquarry.streaming.segments import SegmentedIndex, index_stream, stream_table
from tests.fixture_docs import DOCS, write


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    source, target = tmp_path_factory.mktemp("docs"), tmp_path_factory.mktemp("index")
    return Engine.build_directory(spark, write(source), str(target))


def names(df):
    return sorted(r.file_name[:4] for r in df.collect())


def test_directory_ids_follow_names(engine):
    rows = engine.index.doc_stats.orderBy("doc_id").collect()
    assert [(r.doc_id, r.file_name) for r in rows] == list(enumerate(DOCS))
    assert [r.byte_size for r in rows] == [80, 95, 70, 71, 90]


def test_document_statistics(engine):
    rows = engine.index.doc_stats.orderBy("doc_id").collect()
    assert [round(r.l_d, 9) for r in rows] == [3.907802568, 4.090659452, 3.568402269, 3.568402269, 3.855742130]
    assert [r.doc_length for r in rows] == [10, 13, 9, 9, 13]
    assert [round(r.avg_tftd, 9) for r in rows] == [1.3, 1.153846154, 1.222222222, 1.222222222, 1.076923077]
    assert engine.index.corpus_stats.first()[:2] == (5, 10.8) and engine.vocabulary_size() == 25
    assert engine.index.document_weights(0).first()["avg_doc_length"] == 10.8


def test_postings(engine):
    def postings(term):
        (stemmed,) = engine.analyze(term)["stemmed"]
        return {r.doc_id + 1: list(r.positions) for r in engine.index.postings_of(stemmed).collect()}

    assert postings("alpha") == {1: [8], 2: [12], 5: [5]} and postings("bravo") == {1: [9], 2: [0, 4]}
    assert postings("november") == {1: [2, 3], 2: [5], 5: [0, 8]} and postings("hotel") == {1: [6, 7, 12], 4: [9]}
    assert postings("juliet") == {3: [8], 4: [2, 7], 5: [1]} and postings("nothing") == {}
    index = engine.index
    assert index.document_frequency("hotel") == 2 and index.collection_frequency("hotel") == 4 and index.document_frequency("zzz") == 0
    assert index.total_term_frequency() == sum(len(d.split()) for d in DOCS.values())
    assert index.contains("hotel") and not index.contains("zzz") and index.n_docs() == 5
    assert "positions" not in index.postings_of("hotel", False).columns
    assert {r.term for r in index.terms_of(2).collect()} == {engine.analyze(w)["stemmed"][0] for w in DOCS["doc3.txt"].split()}
    assert [r.term for r in engine.vocabulary(2).collect()] == ["alpha", "bravo"]


@pytest.mark.parametrize(
    "query, docs",
    [
        ("alpha", "125"), ("alpha bravo", "12"), ("alpha -november", ""), ("alpha + mike", "12345"), ("kilo NEAR/3 mike", "2"), ("kilo NEAR/4 mike", "23"), ("mike NEAR/3 kilo", ""),
        ('"alpha bravo"', "1"), ('"november november"', "1"), ("-alpha", ""), ("zzz alpha", ""), ("zzz + alpha", "125"), ("alpha -zzz", "125"), ("alpha (bravo + kilo)", "125"),
        ("mike -kilo NEAR/4 mike", "14"), ("-kilo NEAR/3 mike + xray", "1"), ("mike (alpha + -kilo NEAR/3 mike)", "1234"), ("mike (-alpha + -kilo)", "134"), ("(-alpha + -kilo)", ""), ("papa (-alpha + xray)", "1"),
        ('mike -"alpha bravo"', "234"), ("kilo NEAR/4 mike india", "3"), ("mike NEAR/0 mike", ""), ("qu*", "345"), ("mike -qu*", "12"), ("*vember", "125"), ("al*ha", "125"), ('"alp* bra*"', "1"), ("***", "12345"), ("!!!", ""), ("", ""),
    ],
)
def test_boolean(engine, query, docs):
    assert names(engine.search_boolean(query)) == [f"doc{d}" for d in docs]


GOLDEN = {
    ("hotel november", "default"): {1: 1.097740, 5: 0.430705, 4: 0.351071, 2: 0.239773},
    ("hotel november", "tfidf"): {1: 0.532125, 4: 0.194246},
    ("hotel november", "okapi"): {1: 2.660717, 4: 0.740239, 5: 0.44, 2: 0.22},
    ("hotel november", "wacky"): {1: 0.075363, 4: 0.040077},
    ("bravo sierra", "default"): {2: 1.037051, 3: 0.594415, 1: 0.320580},
    ("bravo sierra", "tfidf"): {2: 0.677785, 3: 0.388492, 1: 0.177375},
    ("bravo sierra", "okapi"): {2: 2.960956, 3: 1.480478, 1: 0.740239},
    ("bravo sierra", "wacky"): {2: 0.123234, 3: 0.068340, 1: 0.035911},
}


@pytest.mark.parametrize("query, scheme", list(GOLDEN))
def test_ranked(engine, query, scheme):
    rows = engine.search_ranked(query, scheme).orderBy("rank").collect()
    assert {int(r.file_name[3]): r.score for r in rows} == pytest.approx(GOLDEN[query, scheme], abs=1.01e-6)
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_ranked_options(spark, engine):
    once, twice = (engine.search_ranked(q).orderBy("doc_id").collect() for q in ("hotel", "hotel hotel"))
    assert [round(2 * r.score, 5) for r in once] == [round(r.score, 5) for r in twice]
    assert engine.search_ranked("zzz").collect() == [] and len(engine.search_ranked("mike", k=2).collect()) == 2
    assert names(engine.search("qu*", "ranked")) == ["doc3", "doc4", "doc5"] and engine.search_ranked("qu*", kgram=False).collect() == []
    for bad in ("a + b", "a -b", '"a b"', "a NEAR/2 b"):
        with pytest.raises(QueryError, match="Invalid Query"):
            engine.search_ranked(bad)
    with pytest.raises(ValueError):
        rank(engine.index, spark.createDataFrame([], "query_id int, term string"), "other")
    batch = engine.search_batch(spark.createDataFrame([(7, "hotel november"), (8, "bravo sierra"), (9, None)], "query_id long, text string"))
    assert {r.query_id: r.score for r in batch.filter("rank = 1").collect()} == {7: 1.09774, 8: 1.037051}
    textbook = engine.search_ranked("november", "tfidf", textbook=True).filter("rank = 1").first()
    assert textbook.score == round(2 * math.log(5 / 3) / 3.855742130, 6)


def test_many_groups_run(engine):
    query = "mike " + " ".join(f"({w} + hotel + {w}z)" for w in "papa romeo november xray delta bravo lima sierra yankee foxtrot charlie tango kilo zulu victor india quebec uniform juliet echo oscar golf alpha mike".split())
    assert names(engine.search_boolean(query + " (a + hotel)" * 6)) == ["doc1", "doc4"]


def near_by_hand(a, b, k):
    return any(1 <= y - x <= k for x in a for y in b)


def test_near_over_many_positions(spark):
    from lexiquarry.operators.retrieval import _follows

    draw = random.Random(3)
    rows = [([draw.randrange(60) for _ in range(draw.randrange(5))], [draw.randrange(60) for _ in range(draw.randrange(5))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    for k in (0, 1, 7):
        got = df.select("a", "b", _follows(F.col("a"), F.col("b"), k).alias("met")).collect()
        assert all(r.met == near_by_hand(r.a, r.b, k) for r in got)


def test_count_and_all_ranks(engine):
    top = engine.search_ranked("mike november", k=2, counted=True).orderBy("rank").collect()
    everything = engine.search_ranked("mike november", k=None).orderBy("rank").collect()
    assert {r.matches for r in top} == {5} and len(everything) == 5 and [r.rank for r in everything] == [1, 2, 3, 4, 5]
    assert [(r.rank, r.doc_id, r.score) for r in top] == [(r.rank, r.doc_id, r.score) for r in everything[:2]]
    assert count_ranked(engine.index, "mike november") == 5 and engine.search_ranked("zzz", k=None, counted=True).collect() == []


def test_plans(spark, engine):
    """A document's terms are counted without a shuffle; ranking joins documents only behind the top k."""
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, body string")
    assert "Exchange" not in forward_table(normalized_documents(docs))._jdf.queryExecution().executedPlan().toString()
    plan = engine.search_ranked("hotel november", "wacky")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/forward") + plan.count("file_name") > 0 and plan.index("Window") > plan.index("Join")


def test_rebuilding_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "i")
    first = Index.build(spark.createDataFrame([(1, "zebra crossing")], "doc_id long, body string"), where)
    assert [r.term for r in expand_by_grams(first, "z*").collect()] == ["zebra"] and first.kgram_status().first().enabled
    second = Index.build(spark.createDataFrame([(1, "apple pie")], "doc_id long, body string"), where, kgram=False)
    for index in (second, Index.open(spark, where)):
        assert not index.has_kgrams and tuple(index.kgram_status().first()) == (False, 0)
        with pytest.raises(NoGrams):
            expand_by_grams(index, "z*")
        assert [r.norm for r in expand_wildcard(index, "a*").collect()] == ["apple"]
    assert len([n for n in workspace.names_in(spark, where) if n.startswith("build=")]) == 1

    def failing(*arguments):
        raise OSError("lost")

    with monkeypatch.context() as patch:  # a build that dies leaves the index as it was
        patch.setattr(workspace, "write_new", failing)
        with pytest.raises(OSError):
            Index.build(spark.createDataFrame([(1, "other")], "doc_id long, body string"), where)
    assert [r.term for r in Index.open(spark, where).vocabulary().collect()] == ["apple", "pie"]
    with pytest.raises(FileNotFoundError):
        Index.open(spark, str(tmp_path / "none"))


def test_stems_and_norms(spark, tmp_path):
    index = Index.build(spark.createDataFrame([(1, "Voting votes long-voted"), (2, "voter"), (3, None)], "doc_id long, body string"), str(tmp_path), "english")
    assert {(r.norm, r.term) for r in index.norms.collect()} == {("voting", "vote"), ("votes", "vote"), ("long", "long"), ("voted", "vote"), ("longvoted", "longvot"), ("voter", "voter")}
    row = index.postings_of("vote").first()
    assert (row.tf_emit, row.tf, list(row.positions)) == (3, 3, [0, 1, 2]) and {r.term for r in index.terms_of(1).collect()} == {"vote", "long", "longvot"}


def test_generated_documents(spark):
    rows = call_word_documents(spark, 200, seed=3).orderBy("doc_id").collect()
    words = [r.body.split() for r in rows]
    assert {len(w) for w in words} == {11, 12, 13, 14, 15} and {x for w in words for x in w} == set(CALL_WORDS)
    assert all(r.body == "\n".join(w) + "\n" and r.byte_size == len(r.body) for r, w in zip(rows, words)) and len({r.body for r in rows}) == 200
    assert call_word_documents(spark, 200, seed=3).exceptAll(spark.createDataFrame(rows)).isEmpty() and call_word_documents(spark, 0).collect() == []


def test_empty_files_are_documents(spark, tmp_path):
    for name, text in {"a.txt": "", "b.txt": "mike", "_hidden.txt": "", "c.json": '{"title": "t", "body": "", "url": ""}'}.items():
        (tmp_path / name).write_text(text)
    rows = read_directory(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.file_name, r.body, r.byte_size) for r in rows] == [("a.txt", "", 0), ("b.txt", "mike", 4), ("c.json", " ", 37)]


def test_two_frequencies(spark, tmp_path):
    index = Index.build(spark.createDataFrame([(1, "test-test"), (2, None), (3, " ** ")], "doc_id long, body string"), str(tmp_path))
    row = index.postings_of("test").first()
    assert (row.tf_emit, row.tf, list(row.positions)) == (2, 1, [0])
    stats = {r.doc_id: r for r in index.doc_stats.collect()}
    assert index.n_docs() == 3 and stats[2].l_d == 0 and stats[2].avg_tftd is None and stats[3].doc_length == 0


def test_empty_collection_and_clashing_columns(spark, tmp_path):
    index = Index.build(spark.createDataFrame([], "doc_id long, body string"), str(tmp_path / "a"))
    assert index.n_docs() == 0 and index.vocabulary_size() == 0
    extra = spark.createDataFrame([(1, "a b a", 5, "x")], "doc_id long, body string, term int, tf string")
    index = Index.build(extra, str(tmp_path / "b"))
    assert {r.term: r.tf for r in index.postings.collect()} == {"a": 2, "b": 1}


def test_grams(spark, tmp_path):
    index = Index.build(spark.createDataFrame([(1, "Castle. canoe été")], "doc_id long, body string"), str(tmp_path))
    of_castle = {r.gram for r in index.kgrams.filter("term = 'castle'").collect()}
    assert of_castle == set("c a s t l e $c ca as st tl le e$ $ca cas ast stl tle le$ $".split())
    assert index.terms_of_gram("zz").collect() == []
    for pattern, found in {"ca*": {"castle", "canoe"}, "*le": {"castle"}, "*as*": {"castle"}, "c*e": {"castle", "canoe"}, "c*n*e": {"canoe"}, "ca*castle": {"castle"}, "castlec*e": set(), "castl*tle": {"castle"}}.items():
        assert {r.norm for r in expand_wildcard(index, pattern).collect()} == found
        assert {r.term for r in expand_by_grams(index, pattern).collect()} == found


def test_open_document_and_json(spark, tmp_path, engine):
    assert engine.open_document("doc3.txt").first().body.split() == DOCS["doc3.txt"].split() and engine.open_document("none").collect() == []
    (tmp_path / "c.txt").write_text("plain  text")
    (tmp_path / "b.json").write_text(json.dumps({"title": "T", "body": " one\n two ", "url": "u", "more": 1}))
    rows = read_directory(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.file_name, r.body, r.url) for r in rows] == [(0, "b.json", "one two ", "u"), (1, "c.txt", "plain  text", "")]
    assert rows[0].title == "T" and rows[1].title.endswith("/c.txt") and rows[0].byte_size == (tmp_path / "b.json").stat().st_size


def test_reopen(spark, engine):
    again = Engine.open(spark, engine.index.path)
    assert again.index.stemmer == "english" and names(again.search_boolean("alpha bravo")) == ["doc1", "doc2"]
    assert Engine.analyze("Swimming,") == {"normalized": ["swimming"], "stemmed": ["swim"]}


CLASSES = {"hamilton": ["power of the union", "union and power power"], "madison": ["people and faction", "faction of people whilst"], "jay": ["treaty with foreign nations"]}
DISPUTED = ["whilst faction people", "foreign treaty", "union power", "***"]


@pytest.fixture(scope="module")
def classes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("classes")
    for name, texts in [*CLASSES.items(), ("disputed", DISPUTED)]:
        (root / name).mkdir()
        for i, text in enumerate(texts):
            (root / name / f"{name}{i}.txt").write_text(text)
    docs = read_classes(spark, {c: str(root / c) for c in CLASSES}, str(root / "disputed"))
    return Engine.build(docs, str(root / "index"), stemmer="none")


def test_classifiers(classes):
    for classifier in Engine.CLASSIFIERS:
        got = {r.file_name: r["class"] for r in classes.classify(classifier, k=50).collect()}
        assert len(got) == 4 and [got[f"disputed{i}.txt"] for i in range(3)] == ["madison", "jay", "hamilton"]
    assert [r["class"] for r in classes.classify("rocchio", "disputed1.txt").collect()] == ["jay"]
    with pytest.raises(ValueError):
        classes.classify("other")


def test_mutual_information(classes):
    own = Classifier(classes.index)
    scores = {(r["class"], r.term): r.score for r in own.mutual_information().collect()}
    assert all(-1e-12 <= s <= 1 for s in scores.values())
    # "power": in both Hamilton papers and in no other one of three.
    assert scores["hamilton", "power"] == pytest.approx(2 / 5 * math.log2(5 / 2) + 3 / 5 * math.log2(5 / 3))
    cells = own.contingency().filter("term = 'of' AND class = 'hamilton'").first()
    assert (cells.n11, cells.n10, cells.n01, cells.n00) == (1, 1, 1, 2)
    top = own.discriminating_terms(4).orderBy("rank").collect()
    assert len({r.term for r in top}) == 4 and [r.term for r in top[:4]] == ["faction", "people", "power", "union"]
    assert own.discriminating_terms(0).collect() == []


def test_centroids_and_vocabulary(classes):
    own = Classifier(classes.index)
    norm = math.sqrt(4)
    jay = {r.term: r.component for r in own.centroids().filter("class = 'jay'").collect()}
    assert jay == pytest.approx({t: 1 / norm for t in "treaty with foreign nations".split()})
    assert own.centroids(2).groupBy("class").count().filter("count > 2").isEmpty()
    assert {(r["class"]): round(r.distance, 9) for r in own.distances().join(classes.index.doc_stats.filter("file_name = 'disputed1.txt'").select("doc_id"), "doc_id").collect()}["jay"] == pytest.approx(
        math.sqrt(1 + 1 - 2 * 2 / math.sqrt(2) / 2)
    )
    labelled = {w for texts in CLASSES.values() for t in texts for w in t.split()}
    assert [r.term for r in classes.all_vocabulary().collect()] == sorted(labelled)


def test_nothing_to_learn_from(spark, tmp_path):
    index = Index.build(spark.createDataFrame([(1, "a b")], "doc_id long, body string"), str(tmp_path))
    own = Classifier(index)
    assert own.classify_bayes().collect() == [] and own.classify_rocchio().collect() == [] and own.discriminating_terms().collect() == []


def test_segments(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(DOCS.values())), "doc_id long, body string").withColumn("file_name", F.concat(F.lit("doc"), F.col("doc_id") + 1))
    source = str(tmp_path / "in")
    for part in (F.col("doc_id") < 2, F.col("doc_id") >= 2):
        docs.filter(part).write.mode("append").parquet(source)
        query = index_stream(stream_table(spark, source, docs.schema), str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
        query.awaitTermination()
    index = SegmentedIndex.open(spark, str(tmp_path / "out"))
    engine = Engine(index)
    assert index.n_docs() == 5 and index.document_frequency("hotel") == 2 and names(engine.search_boolean("alpha + mike")) == [f"doc{i}" for i in range(1, 6)]
    assert {int(r.file_name[3]): r.score for r in engine.search_ranked("hotel november").collect()} == pytest.approx(GOLDEN["hotel november", "default"], abs=1.01e-6)
