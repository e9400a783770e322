import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiquarry.llm import tokenizer

pytest.importorskip("sentencepiece")
tiktoken = pytest.importorskip("tiktoken")

RANKS = tokenizer.read_ranks(tokenizer.vocabulary())
OWN = tokenizer.encoder(tokenizer.model(RANKS))
REFERENCE = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "Hello  world\n\n\tdon't we'll", "naïve café — “so it goes” …", "日本の山と川。 🔥🌲 क्षेत्र مرحبا", "<|endoftext|>", "\x00\x7f​﻿", "a" * 30_000, " " * 5000 + "x", "▁ _ ▁▁", "x\r\ny"]


def test_same_ids_as_another_implementation():
    for text in TEXTS:
        assert OWN.encode([text]) == [REFERENCE.encode_ordinary(text)]
        assert OWN.decode(OWN.encode([text])[0]) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    (ids,) = OWN.encode([text])
    assert ids == REFERENCE.encode_ordinary(text) and OWN.decode(ids) == text


def test_column(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x"), (5, TEXTS[2]), (5, TEXTS[2])]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, ids string, n int")
    encoded = tokenizer.encode(df, "doc_id", "text")
    assert encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in encoded.collect())
    assert got == sorted(((d or 0), REFERENCE.encode_ordinary(t or "")) for d, t in rows)
    assert sorted((r.doc_id or 0, r.text) for r in tokenizer.decode(encoded, "doc_id").collect()) == sorted((d or 0, t or "") for d, t in rows)
    assert tokenizer.encode(df.limit(0), "doc_id", "text").collect() == []


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        tokenizer.model({b"a": 0, b"b": 2})


def test_lists_that_encode_no_text(spark):
    (ids,) = OWN.encode(["a🔥"])
    assert OWN.decode(ids[:-1]) == "a�" and OWN.decode([None, *ids, -1, 10**6, len(RANKS)]) == "�a🔥���" and OWN.decode([]) == ""
    df = spark.createDataFrame([(1, ids[:-1]), (2, None), (3, [None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokenizer.decode(df, "doc_id").collect()} == {1: "a�", 2: None, 3: "�"}
