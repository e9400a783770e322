import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexiquarry import workspace
from lexiquarry.llm import term_counts
from lexiquarry.llm.distinctive import most_characteristic, residual_idf, residual_statistics
from lexiquarry.llm.record_terms import record_terms
from lexiquarry.llm.term_counts import TermCounts, marked
from lexiquarry.workspace import materialize

SCHEMA = "term string, m_doc_id long, m_positions array<int>, tf string, doc_id int"


def postings(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [
    ("a", 1, [0, 2]), ("a", 1, [0, 2]), ("a", 1, [2, 5]), ("b", 1, [1]), ("b", 2, [0]), ("c", 2, [1, None]), ("a", 3, [0]), ("d", 3, [1]), ("e", 3, [2]), ("d", 4, [3]), ("e", 4, [4]),
    (None, 1, [1]), ("x", None, [1]), ("x", 5, None), ("x", 5, []), ("x", 5, [None]),
]
TF = {("a", 1): 3, ("b", 1): 1, ("b", 2): 1, ("c", 2): 1, ("a", 3): 1, ("d", 3): 1, ("e", 3): 1, ("d", 4): 1, ("e", 4): 1}


def test_record_terms(spark):
    assert {(r.term, r.doc_id): r.tf for r in record_terms(postings(spark, ROWS)).collect()} == TF
    assert record_terms(postings(spark, [])).collect() == []


def test_scores_by_hand_with_and_without_broadcast(spark):
    pairs = materialize(record_terms(postings(spark, ROWS)), "t")
    for limit in (1 << 20, 0):
        scored = {(r.term, r.doc_id): r for r in residual_idf(pairs, limit).collect()}
        assert set(scored) == set(TF)
        n = {"a": 2, "b": 2, "c": 1, "d": 2, "e": 2}
        for (term, doc), r in scored.items():
            cf = sum(tf for (t, _), tf in TF.items() if t == term)
            observed, expected = math.log(4 / n[term]), -math.log(1 - math.exp(-cf / 4))
            assert (r.n, r.cf, r.tf) == (n[term], cf, TF[term, doc])
            assert abs(r.score - TF[term, doc] * (observed - expected)) < 1e-6 and abs(r.weight - TF[term, doc] * observed) < 1e-6
    scored = residual_idf(pairs)
    best = {r.doc_id: r.term for r in most_characteristic(scored.filter("n > 1"), "weight").collect()}
    assert best == {1: "a", 2: "b", 3: "a", 4: "d"}  # ties: the first in byte order
    assert residual_idf(record_terms(postings(spark, []))).collect() == []


def test_byte_order_of_ties(spark):
    rows = [(t, d, [0]) for t in ("é", "z", "Z", "\U0001f525") for d in (1, 2)] + [("q", 3, [0])]
    scored = residual_idf(materialize(record_terms(postings(spark, rows)), "t")).filter("n > 1")
    assert {r.doc_id: r.term for r in most_characteristic(scored, "weight").collect()} == {1: "Z", 2: "Z"}


def brute(collection):
    counts = defaultdict(lambda: [0, 0])
    for doc in collection.values():
        for term, tf in doc.items():
            counts[term][0] += tf
            counts[term][1] += 1
    return {t: tuple(c) for t, c in counts.items()}


def as_pairs(spark, collection):
    return spark.createDataFrame([(t, d, tf) for d, doc in collection.items() for t, tf in doc.items()], "term string, doc_id long, tf long")


def counts(store):
    return {r.term: (r.occurrences, r.records) for r in store.counts().collect()}


def test_signed_deltas_against_counting_anew(spark, tmp_path):
    first = {d: {f"t{d % 3}": 1 + d % 2, "all": 1} for d in range(12)}
    store = TermCounts(spark, str(tmp_path / "s"), buckets=4)
    assert counts(store) == {} and store.n_records() == 0
    assert store.apply(as_pairs(spark, first)) == {"added": 12, "changed": 0, "deleted": 0} and counts(store) == brute(first)
    before = store.manifest
    assert store.apply(as_pairs(spark, first)) == {"added": 0, "changed": 0, "deleted": 0} and store.manifest == before

    second = {d: v for d, v in first.items() if d not in (3, 4)} | {0: {"new": 5, "all": 1}, 50: {"t1": 2}}
    assert store.apply(as_pairs(spark, second)) == {"added": 1, "changed": 1, "deleted": 2} and counts(store) == brute(second)
    again = TermCounts(spark, str(tmp_path / "s"))  # opened anew
    assert counts(again) == brute(second) and again.n_records() == len(second)

    third = second | {50: {"t1": 3}, 51: {"z": 1}}
    third.pop(1)
    gone = spark.createDataFrame([(1,), (1,), (None,), (999,)], "doc_id long")
    assert again.apply(as_pairs(spark, {50: third[50], 51: third[51]}), whole=False, deleted=gone) == {"added": 1, "changed": 1, "deleted": 1}
    assert counts(again) == brute(third)
    assert again.apply(as_pairs(spark, {})) == {"added": 0, "changed": 0, "deleted": len(third)} and counts(again) == {} and again.n_records() == 0
    assert again.apply(as_pairs(spark, first))["added"] == 12 and counts(again) == brute(first)


def test_a_small_change_writes_little_and_buckets_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_counts, "SEGMENTS", 3)
    collection = {d: {f"w{d}": 1} for d in range(64)}
    store = TermCounts(spark, str(tmp_path / "s"), buckets=8)
    store.apply(as_pairs(spark, collection))
    most = 0
    for tf in range(2, 7):
        before = store.manifest
        store.apply(as_pairs(spark, {7: {"w7": tf}}), whole=False)
        for table in ("records", "prints", "counts"):
            assert sum(store.manifest[table][b] != before[table][b] for b in before[table]) == 1
            most = max(most, *map(len, store.manifest[table].values()))
        assert counts(store) == brute(collection | {7: {"w7": tf}}) and store.n_records() == 64
    assert most == 3
    assert store.vacuum() > 0 and store.vacuum() == 0 and counts(TermCounts(spark, str(tmp_path / "s"))) == brute(collection | {7: {"w7": 6}})


@pytest.mark.parametrize("dies", ["_write:0", "_write:1", "_write:2", "write_new:0", "renamed"])
def test_a_change_that_dies_can_be_tried_again(spark, tmp_path, monkeypatch, dies):
    first, second = {1: {"a": 1}, 2: {"a": 2, "b": 1}}, {1: {"a": 5}, 3: {"c": 1}}
    where = str(tmp_path / "s")
    TermCounts(spark, where, buckets=2).apply(as_pairs(spark, first))
    name, _, number = dies.partition(":")
    with monkeypatch.context() as patch:
        if name == "_write":
            calls, write = [], TermCounts._write

            def failing(self, *arguments):
                calls.append(1)
                if len(calls) > int(number):
                    raise OSError("lost")
                return write(self, *arguments)

            patch.setattr(TermCounts, "_write", failing)
        else:  # just before the manifest is in force, or just after
            make = workspace.write_new

            def failing(*arguments):
                if name == "renamed":
                    make(*arguments)
                raise OSError("lost")

            patch.setattr(term_counts.workspace, "write_new", failing)
        with pytest.raises(OSError, match="lost"):
            TermCounts(spark, where).apply(as_pairs(spark, second))
    again = TermCounts(spark, where)
    assert counts(again) == brute(second if dies == "renamed" else first)
    again.apply(as_pairs(spark, second))
    assert counts(again) == brute(second) == counts(TermCounts(spark, where))
    again.vacuum()
    assert counts(TermCounts(spark, where)) == brute(second) and again.n_records() == 2


def test_two_changes_at_a_time_and_half_a_manifest(spark, tmp_path):
    where = str(tmp_path / "s")
    one, other = TermCounts(spark, where, buckets=2), TermCounts(spark, where, buckets=2)
    one.apply(as_pairs(spark, {1: {"a": 1}}))
    with pytest.raises(FileExistsError):
        other.apply(as_pairs(spark, {1: {"b": 1}}))
    workspace.write_new(spark, f"{where}/manifests/{9:012d}.json", '{"change": 9, "buck')
    assert counts(TermCounts(spark, where)) == {"a": (1, 1)}


def test_expectation_of_rare_terms(spark):
    """Where cf / N is tiny, the expectation is ln(N / cf) to all digits."""
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 3), ("c", 2, 2)], "term string, n long, cf long")
    for n_records in (10**10, 10**17):
        got = {r.term: r for r in residual_statistics(rows, n_records).collect()}
        for term, n, cf in (("a", 1, 1), ("b", 1, 3), ("c", 2, 2)):
            assert abs(got[term].expected - math.log(n_records / cf)) < 1e-9 and abs(got[term].residual - math.log(cf / n)) < 1e-9


def test_plans(spark):
    """One shuffle gives the pairs, and the weight of p3_found is read from the residual."""
    plan = record_terms(postings(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    scored = residual_idf(materialize(record_terms(postings(spark, ROWS)), "t")).filter("n > 1")
    assert "residual" in most_characteristic(scored, "weight")._jdf.queryExecution().optimizedPlan().toString()


def test_marks(spark):
    df = spark.createDataFrame([("rare", 9, 2), ("kept", 9, 3), ("edge", 9, 75), ("common", 99, 76)], "term string, occurrences long, records long")
    assert {tuple(r) for r in marked(df, 100).collect()} == {("rare", "rare"), ("common", "common")}
    tiny = spark.createDataFrame([("a", 2, 2), ("b", 1, 1)], "term string, occurrences long, records long")
    assert {tuple(r) for r in marked(tiny, 2).collect()} == {("a", "rare"), ("a", "common"), ("b", "rare")}
    assert marked(df.limit(0), 0).collect() == []


def test_hot_posting(spark):
    """A third of all rows are one posting sent again."""
    rows = postings(spark, ROWS).union(spark.range(2000).select(F.lit("a"), F.lit(1).cast("long"), F.array(F.lit(0), F.lit(2)), F.lit("x"), F.lit(1)))
    assert {(r.term, r.doc_id): r.tf for r in record_terms(rows).collect()} == TF
