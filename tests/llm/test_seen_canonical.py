import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiquarry.llm.canonical import canonical_forms, look_alike_pairs, once
from lexiquarry.llm.seen import LOOK_ALIKES, as_seen, folded, words

SAME = [
    "The café at Kärnholt, 12 m².",
    "The café at Kärnholt, 12 m².",
    " Ｔｈｅ café at\n\nKärnholt， １２ m².​",
    "Th­e cаfé аt Kärnhοlt, 12　m².",
    "Тhе cafе́ at Kärnholt, 12 m².",
]
OTHERS = ["the café at Kärnholt, 12 m².", "The cafe at Kärnholt, 12 m².", "The café at Kärnholt, 12 m2.", "The café at Kärnholt 12 m²."]


def test_forms_of_one_wording():
    assert {as_seen(t) for t in SAME} == {SAME[0]}
    assert len({as_seen(t) for t in OTHERS} | {SAME[0]}) == 5
    assert words(SAME[2]) == ["the", "café", "at", "kärnholt", "12", "m²"] and words(None) == words(" ​") == []


def test_look_alikes_of_many_scripts():
    assert as_seen("Ӏѵοry Ꮃіnԁ νаսlt ꓢаոԁ") == "Ivory Wind vault Sand" and as_seen("жук λέων") == "жyк λέωv"
    assert all(len(a) == len(b) == 1 and b.isascii() and a.lower() not in LOOK_ALIKES or LOOK_ALIKES.get(a.lower(), "").isascii() for a, b in LOOK_ALIKES.items())


def test_pairs(spark):
    rows = [(i, t) for i, t in enumerate(SAME)] + [(10 + i, t) for i, t in enumerate(OTHERS)]
    rows += [(20, SAME[0]), (0, SAME[0]), (30, None), (31, ""), (32, " ​\n"), (33, "\t"), (None, SAME[1])]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, body string, loaded_at int, canonical string, _form string")
    got = {tuple(r) for r in look_alike_pairs(df, "doc_id", "body").collect()}
    stored = {**dict(enumerate(SAME)), 20: SAME[0]}
    assert got == {(a, b) for a in stored for b in stored if a < b and stored[a] != stored[b]}
    forms = {r.doc_id: (r.canonical, r.class_id) for r in canonical_forms(df, "doc_id", "body").collect()}
    assert {forms[i] for i in stored} == {(SAME[0], 0)} and forms[30] == forms[31] == forms[32] == (None, None) and None not in forms
    assert len({forms[10 + i][1] for i in range(4)}) == 4


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, body string")
    assert look_alike_pairs(empty, "doc_id", "body").collect() == [] and canonical_forms(empty, "doc_id", "body").collect() == []
    long = "wörd а " * 100_000
    df = spark.createDataFrame([(1, long), (2, unicodedata.normalize("NFD", long))], "doc_id long, body string")
    assert [tuple(r) for r in look_alike_pairs(df, "doc_id", "body").collect()] == [(1, 2)]


def test_one_class_of_most_rows(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a b")).when(F.col("id") == 1, F.lit("а b")).otherwise(F.concat(F.lit("n"), "id")).alias("body"))
    assert {tuple(r) for r in look_alike_pairs(df, "doc_id", "body").collect()} == {(min(1, i), max(1, i)) for i in range(0, 300, 3)}


def test_latest_load(spark):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "a", 1), (2, "b", 1), (3, None, 1), (None, "x", 1)], "k long, v string, at int")
    assert {tuple(r) for r in once(df, "k", ["v"], "at").collect()} == {(1, "new"), (2, "b"), (3, None)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=[*"aAeE é\n.1²", "́", "̈", "​", " ", *list(LOOK_ALIKES)[:20], "ａ", "１", "K"], max_size=12))
def test_stable(text):
    assert as_seen(as_seen(text)) == as_seen(text)


def test_collation_agrees_with_composed_forms(spark):
    """The classes of the SQL grouping are those of the Python form, over many short texts."""
    import random

    draw = random.Random(5)
    alphabet = ["a", "A", "é", "é", "е", "ο", "Κ", "K", "ａ", "²", "2", "​", " ", "　", "\n", "ö", "ö", "ß", "æ", "-", "－", "ж", "­"]
    rows = [(i, "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 4)))) for i in range(1500)]
    classes, forms = {}, {}
    for r in canonical_forms(spark.createDataFrame(rows, "doc_id long, body string"), "doc_id", "body").collect():
        if r.class_id is not None:
            classes.setdefault(r.class_id, set()).add(r.doc_id)
    for i, t in rows:
        if as_seen(t):
            forms.setdefault(as_seen(t), set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, forms.values()))


@pytest.mark.parametrize("text", [None, "", " ​ ", "a\u0085b", "x\U000e0041y"])
def test_folded_column(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(folded(F.col("t"))).first()[0]
    assert got is None if text is None else got == as_seen(text)
