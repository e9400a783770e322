import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiquarry.llm import leakage
from lexiquarry.llm.seen import words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(symbols):
    got = leakage.suffix_array(np.array(symbols + [9]))
    assert got.tolist() == sorted(range(len(symbols) + 1), key=lambda i: (symbols + [9])[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=200))
def test_wavelet_matrix(symbols):
    matrix = leakage.WaveletMatrix.of(np.array(symbols), 4)
    n = len(symbols)
    assert matrix.access(np.arange(n)).tolist() == symbols
    for c in range(13):
        assert matrix.rank(np.full(n + 1, c), np.arange(n + 1)).tolist() == [symbols[:i].count(c) for i in range(n + 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=150), min_size=1, max_size=5), st.integers(1, 4))
def test_search_and_locate(pieces, width):
    coded = [np.array(p, np.uint64) * 7 for p in pieces]
    index = leakage.FMIndex.of(coded, [0] * len(pieces), [0] * len(pieces))
    index = leakage.FMIndex.load(index.save())
    patterns = np.array([[(i >> 2 * j) % 4 for j in range(width)] for i in range(4**width)] + [[9] * width])
    symbols = index.numbers(patterns.ravel().astype(np.uint64) * 7)
    found = sorted(zip(*(x.tolist() for x in index.search(symbols, np.arange(len(patterns)) * width, width))))
    expected = sorted(
        (row, int(start) + at)
        for row, pattern in enumerate(patterns.tolist())
        for start, piece in zip(index.starts, pieces)
        for at in range(len(piece) - width + 1)
        if piece[at : at + width] == pattern
    )
    assert found == expected


def pairs_and_places(docs, items, **setting):
    found = leakage.occurrences(docs, items, **setting)
    window = setting.get("window", 12)
    return found, leakage.leaks(found, leakage.item_phrases(items, window=window))


def brute(docs, items, window):
    out = set()
    for d, text in docs:
        for i, item in items:
            if d is not None and i is not None and text and item:
                a, b = words(text), words(item)
                runs = {tuple(b[k : k + window]) for k in range(len(b) - window + 1)}
                out |= {(d, i, k) for k in range(len(a) - window + 1) if tuple(a[k : k + window]) in runs}
    return out


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, doc string, word int"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, item string"),
    )


def test_against_brute_force(spark):
    draw = random.Random(2)
    text = lambda n: " ".join(draw.choice("abcd") + draw.choice("xyz") for _ in range(n))
    items = [(i, text(30)) for i in range(12)] + [(20, text(3)), (21, None), (22, ""), (None, text(30))]
    items += [(30, items[0][1]), (31, items[0][1] + " " + text(4))]
    docs = [(i, text(40)) for i in range(30)]
    docs += [(100 + i, f"{text(5)}. {items[i][1].upper()}! {text(9)}") for i in range(6)]
    docs += [(200, None), (201, ""), (202, "​"), (203, items[1][1]), (None, items[1][1]), (204, " ".join(items[2][1].split()[:8]))]
    docs += [(300, " ".join(f"{text(50)} {items[k % 12][1]}" for k in range(40)))]
    d, i = tables(spark, docs, items)
    expected = brute(docs, items, 8)
    for shard, block in ((400_000, 1_000_000), (37, 1_000_000), (500, 70)):
        found, leaking = pairs_and_places(d, i, window=8, shard_words=shard, block_words=block)
        assert found.columns == ["doc_id", "phrase", "word"]
        assert {(r.doc_id, r.word) for r in found.collect()} == {(x[0], x[2]) for x in expected}
        rows = [tuple(r) for r in leaking.collect()]
        assert set(rows) == {x[:2] for x in expected} and len(rows) == len(set(rows))
    spans = {(r.doc_id, r.first_word, r.last_word) for r in leakage.removal_spans(found, window=8).collect()}
    covered = {(doc, w + k) for doc, _, w in expected for k in range(8)}
    assert {(doc, w) for doc, a, b in spans for w in range(a, b + 1)} == covered and not any((doc, b + 1) in covered for doc, _, b in spans)


def test_empty_tables(spark):
    d, i = tables(spark, [(1, "a b c d")], [(1, "a b c d")])
    assert [(r.doc_id, r.word) for r in leakage.occurrences(d, i, window=4).collect()] == [(1, 0)]
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d, i.filter("text = 'none'"))):
        found, leaking = pairs_and_places(docs, items, window=4)
        assert found.collect() == [] and leaking.collect() == [] and leakage.removal_spans(found, window=4).collect() == []


def test_one_index_a_shard_for_all_blocks(spark, monkeypatch):
    built = spark.sparkContext.accumulator(0)
    make = leakage._indexes

    def counting(*arguments):
        for index in make(*arguments):
            built.add(1)
            yield index

    monkeypatch.setattr(leakage, "_indexes", counting)
    texts = [" ".join(f"w{k}" for k in range(i, i + 12)) for i in range(6)]
    docs, items = tables(spark, [(i, f"so {t} on") for i, t in enumerate(texts)], list(enumerate(texts)))
    found = leakage.occurrences(docs.coalesce(1), items, window=10, shard_words=40, block_words=25)
    assert {(r.doc_id, r.word) for r in found.collect()} >= {(i, 1) for i in range(6)} and found.count() > 6
    assert built.value == 2  # of three documents each, for three blocks, read twice


def test_repeated_document_ids_and_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    long = ("same word " * 150_000) + passage + (" other" * 150_000)
    docs, items = tables(spark, [(1, long), (1, passage), (2, "same word " * 20)], [(1, passage), (2, "same word " * 8)])
    assert {tuple(r) for r in pairs_and_places(docs, items.filter(F.col("item_id") == 1))[1].collect()} == {(1, 1)}
    assert {tuple(r) for r in pairs_and_places(docs.filter("doc_id = 2"), items)[1].collect()} == {(2, 2)}
