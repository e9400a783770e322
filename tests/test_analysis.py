import pytest

from lexiquarry.functions import varbyte
from lexiquarry.functions.analysis import analyze, normalize, terms, tokens
from lexiquarry.functions.porter2 import stem

EDGE_CASES = {
    "Hello,": ["hello"], '"(Hello)"': ["hello"], "***": [], "don't": ["dont"], "don’t": ["dont"], "mother-in-law": ["mother", "in", "law", "motherinlaw"],
    "f(x)y": ["f", "x", "y", "fxy"], "test-test": ["test", "test", "testtest"], "a---b": ["a", "b", "ab"], "a-----b": ["a", "b", "ab"], "été,": ["été"], "3.14": ["3.14"], "$100": ["100"],
}


def test_edge_cases_in_both_forms(spark):
    assert {t: normalize(t) for t in EDGE_CASES} == EDGE_CASES
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_CASES)], "doc_id long, body string")
    got = {i: [] for i in range(len(EDGE_CASES))}
    for r in terms(df).orderBy("doc_id", "pos", "sub").collect():
        got[r.doc_id].append(r.term)
    assert list(got.values()) == list(EDGE_CASES.values())


def test_positions_count_raw_tokens(spark):
    df = spark.createDataFrame([(1, " a *** b\n"), (2, None), (3, " \t ")], "doc_id long, body string")
    assert [(r.doc_id, r.pos, r.raw) for r in tokens(df).collect()] == [(1, 0, "a"), (1, 1, "***"), (1, 2, "b")]
    assert [(r.pos, r.term) for r in terms(df).collect()] == [(0, "a"), (2, "b")]


@pytest.mark.parametrize(
    "word, expected",
    [
        *{
            "swimming": "swim", "swam": "swam", "swimmer": "swimmer", "tested": "test", "testing": "test", "needlessly": "needless", "fasting": "fast", "faster": "faster", "seeding": "seed", "seeds": "seed",
            "consistently": "consist", "consolations": "consol", "conspiracy": "conspiraci", "knackeries": "knackeri", "knightly": "knight", "knives": "knive", "hopping": "hop", "hoped": "hope", "generously": "generous",
            "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "agreed": "agre", "feed": "feed", "relational": "relat", "hopefulness": "hope", "replacement": "replac", "adoption": "adopt",
            "analogy": "analog", "dying": "die", "skies": "sky", "succeed": "succeed", "bed": "bed", "november": "novemb", "": "", "y": "y", "été": "été",
        }.items()
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_stemmed_terms(spark):
    df = spark.createDataFrame([(1, "Testing tEsts, mother-in-law")], "doc_id long, body string")
    assert [r.term for r in terms(df, stemmer="english").orderBy("pos", "sub").collect()] == ["test", "test", "mother", "in", "law", "motherinlaw"]
    assert analyze("Swimming", "english") == ["swim"]
    with pytest.raises(ValueError):
        terms(df, stemmer="latin")


def test_variable_bytes():
    assert varbyte.encode(5) == b"\x85" and varbyte.encode(824) == b"\x06\xb8" and varbyte.encode(214577) == b"\x0d\x0c\xb1"
    numbers = [0, 1, 127, 128, 129, 16383, 16384, 2**32 - 1]
    assert varbyte.decode(b"".join(map(varbyte.encode, numbers))) == numbers
    assert varbyte.decode_gaps(varbyte.encode_gaps(numbers)) == numbers
    with pytest.raises(ValueError):
        varbyte.decode(b"\x06")
