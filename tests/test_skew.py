from collections import defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiquarry.operators import skew
from lexiquarry.operators.skew import _runs, heavy_keys, key_states
from lexiquarry.workspace import materialize


def brute(rows):
    docs = defaultdict(set)
    for k, r, p in rows:
        if None not in (k, r, p):
            docs[k, r].add(p)
    out = {}
    for (k, _), ps in docs.items():
        a, b, c = out.get(k, (0, 0, 0))
        out[k] = (a + len(ps), b + 1, max(c, len(ps)))
    return out


row = st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.integers(0, 4))


@settings(max_examples=400, deadline=None)
@given(st.lists(row, max_size=40), st.lists(st.integers(1, 7), min_size=1, max_size=40), st.sets(st.integers(0, 40), max_size=4))
def test_cuts_and_batches_do_not_change_the_result(rows, sizes, cuts):
    rows.sort()
    # Cut anywhere, also between equal rows, as the counter behind the position allows.
    edges = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    parts = [rows[a:b] for a, b in zip(edges, edges[1:]) if a < b]
    ends = defaultdict(set)
    runs = defaultdict(lambda: [0, 0, 0])
    for part in parts:
        batches, i, j = [], 0, 0
        while i < len(part):
            b = part[i : i + sizes[j % len(sizes)]]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*b), (pa.string(), pa.int64(), pa.int64()))], names=["k", "r", "p"]))
            i, j = i + len(b), j + 1
        boundary = 0
        for out in _runs(iter(batches)):
            for x in out.to_pylist():
                s = runs[x["k"], x["r"]]
                if x["r"] is None:
                    s[0], s[1], s[2] = s[0] + x["occurrences"], s[1] + x["records"], max(s[2], x["max_in_record"])
                else:
                    boundary += 1
                    s[0] += x["occurrences"] - len({x["first"], x["last"]})
                    s[1] = 1
                    ends[x["k"], x["r"]] |= {x["first"], x["last"]}
        assert boundary <= 2
    got = {}
    for (k, r), (a, b, c) in runs.items():
        if r is not None:
            a = c = a + len(ends[k, r])
        x = got.get(k, (0, 0, 0))
        got[k] = (x[0] + a, x[1] + b, max(x[2], c))
    assert got == brute(rows)


def test_nulls_repeats_clashing_columns_and_heavy_key(spark):
    rows = [("hot", d, p) for d in range(30) for p in range(40)] + [("hot", 1, 1)] * 50 + [("cold", 1, 1), (None, 1, 1), ("cold", None, 2), ("cold", 3, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "term string, m_doc_id long, pos int, k string, occurrences int")
    states = materialize(key_states(df, "term", "m_doc_id", "pos", partitions=7), "t")
    assert {r[0]: tuple(r)[1:] for r in states.collect()} == brute(rows)
    assert [r[0] for r in heavy_keys(states, "term", 70).collect()] == ["hot"]


def test_empty_table(spark):
    states = key_states(spark.createDataFrame([], "term string, m_doc_id long, pos int"), "term", "m_doc_id", "pos")
    assert states.collect() == [] and heavy_keys(states, "term", 70).collect() == []


def test_hot_row_and_partitions_by_size(spark, monkeypatch):
    hot = spark.range(50_000).selectExpr("'a' AS k", "1L AS r", "2L AS p").unionAll(spark.range(300).selectExpr("'b'", "id", "id % 2"))
    for size in (32 << 20, 1000):  # as the setting says, and many partitions
        monkeypatch.setattr(skew, "PARTITION_BYTES", size)
        got = {tuple(r) for r in key_states(hot, "k", "r", "p").collect()}
        assert got == {("a", 1, 1, 1), ("b", 300, 300, 1)}


def test_a_row_repeated_without_end_is_cut(spark):
    hot = spark.range(0, 40_000, 1, 4).selectExpr("'a' AS term", "1L AS m_doc_id", "2 AS pos").unionAll(spark.range(100).selectExpr("'a'", "1L", "cast(id AS int)"))
    run = skew._runs

    def counting(batches):
        seen = list(batches)
        yield from run(iter(seen))
        if n := sum(b.num_rows for b in seen):
            rows.add(n)

    from pyspark.accumulators import AccumulatorParam

    class Most(AccumulatorParam):
        def zero(self, value):
            return value

        def addInPlace(self, a, b):
            return max(a, b)

    rows = spark.sparkContext.accumulator(0, Most())
    skew._runs = counting
    try:
        got = [tuple(r) for r in key_states(hot, "term", "m_doc_id", "pos", partitions=8).collect()]
    finally:
        skew._runs = run
    assert got == [("a", 100, 1, 100)] and rows.value < 12_000
