import pytest

from lexiquarry.plans.query_parser import Literal, Near, QueryError, Word, parse, parse_tree, to_dnf


@pytest.mark.parametrize(
    "query, clauses",
    [
        ("granite (arch + ridge)", ["granite arch", "granite ridge"]),
        (
            'ivory -mud + "old road" + "salt flat" -mud (tin roof + (low tide + high tide) + iron gate) + moss',
            ["ivory -mud", '"old road"', '"salt flat" -mud tin roof', '"salt flat" -mud low tide', '"salt flat" -mud high tide', '"salt flat" -mud iron gate', "moss"],
        ),
        ("lake NEAR\\4 shore (x + y)", ["lake NEAR\\4 shore x", "lake NEAR\\4 shore y"]),
        ("a NEAR/3 b c", ["a NEAR/3 b c"]),
        ("-a NEAR/3 b c", ["-a NEAR/3 b c"]),
        ("c (d + -a* NEAR/12 b)", ["c d", "c -a* NEAR/12 b"]),
        ("a (b + c) d", ["a b d", "a c d"]),
        ("(x)", ["x"]),
        ('"x"', ["x"]),
        ('a "b c', ['a "b c"']),
        ('"a + (b"', ['"a + (b"']),
        ('-"a b" c', ['-"a b" c']),
        ("a (b + -c)", ["a b", "a -c"]),
        ("a + + b", ["a", "b"]),
        ("", []),
        ("()", []),
    ],
)
def test_disjunctive_form(query, clauses):
    assert to_dnf(query) == clauses


@pytest.mark.parametrize("query", ["(a", "a)", "-(a b)", "(a (b)"])
def test_imbalance(query):
    with pytest.raises(QueryError):
        parse(query)


@pytest.mark.parametrize("query", ["a NEAR/3", "NEAR/3 a", "a NEAR/3 +", "a NEAR/3 -b", "a -NEAR/3 b", '"a b" NEAR/3 c', 'a NEAR/3 "b c"', "a NEAR/3 (b + c)", "(a b) NEAR/3 c", "a NEAR/3 b NEAR/3 c", "a + NEAR/3 b", "a NEAR/3 NEAR/3 b"])
def test_near_takes_a_word_on_either_side(query):
    with pytest.raises(QueryError):
        parse(query)


def test_a_minus_negates_the_whole_of_near():
    assert parse("-kilo NEAR/3 mike") == [(Literal(Near(Word("kilo"), Word("mike"), 3), True),)]


def test_the_tree_is_as_long_as_the_query():
    tree = parse_tree(" ".join(f"(a{i} + b{i})" for i in range(200)))
    assert len(tree.items) == 1 and len(tree.items[0].items) == 200
