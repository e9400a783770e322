"""The query language.

    query  := clause ('+' clause)*            OR of clauses
    clause := item+                           AND of items
    item   := '-'? (term | '"' term+ '"' | wildcard | term 'NEAR/'INT term) | '(' query ')'

Quotes protect the signs inside them; a phrase that isn't closed runs to the end; a phrase
of one word is a term. A minus in front of a NEAR negates the whole of it. Parsing gives a
tree, which is what is executed; its clauses in disjunctive form, which can be many more,
are for display.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product


class QueryError(ValueError):
    """The query can't be parsed, or not be used in this mode."""


@dataclass(frozen=True)
class Word:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Wildcard:
    pattern: str

    def __str__(self) -> str:
        return self.pattern


@dataclass(frozen=True)
class Phrase:
    words: tuple[Word | Wildcard, ...]

    def __str__(self) -> str:
        return f'"{" ".join(map(str, self.words))}"'


@dataclass(frozen=True)
class Near:
    first: Word | Wildcard
    second: Word | Wildcard
    distance: int

    def __str__(self) -> str:
        return f"{self.first} NEAR/{self.distance} {self.second}"


@dataclass(frozen=True)
class Literal:
    atom: Word | Wildcard | Phrase | Near
    negated: bool = False

    def __str__(self) -> str:
        return ("-" if self.negated else "") + str(self.atom)


@dataclass(frozen=True)
class And:
    items: tuple[Literal | Or, ...]


@dataclass(frozen=True)
class Or:
    items: tuple[And, ...]


Clause = tuple[Literal, ...]

_LEXEME = re.compile(r'(?P<quote>-?"[^"]*(?:"|$))|(?P<open>-?\()|(?P<close>\))|(?P<word>[^\s()"]+)')
_NEAR = re.compile(r"-?NEAR/(\d+)")


def _atom(text: str) -> Word | Wildcard:
    return Wildcard(text) if "*" in text else Word(text)


def parse_tree(query: str) -> Or:
    """The query as OR of ANDs of literals and groups; without items for an empty query."""
    lexemes = [(m.lastgroup, m.group()) for m in _LEXEME.finditer(query)]
    tree, at = _query(lexemes, 0, 0)
    if at < len(lexemes):
        raise QueryError("a parenthesis is closed that wasn't opened")
    return tree


def _operand(lexemes: list, at: int) -> bool:
    """Whether a plain word stands at a place, as NEAR takes one on its right."""
    return at < len(lexemes) and lexemes[at][0] == "word" and lexemes[at][1] != "+" and not lexemes[at][1].startswith("-") and not _NEAR.fullmatch(lexemes[at][1])


def _near_at(lexemes: list, at: int) -> re.Match | None:
    return _NEAR.fullmatch(lexemes[at][1]) if at < len(lexemes) and lexemes[at][0] == "word" else None


def _query(lexemes: list, at: int, depth: int) -> tuple[Or, int]:
    clauses: list[And] = []
    items: list[Literal | Or] = []  # of the open clause

    def close() -> None:
        if items:
            clauses.append(And(tuple(items)))
            items.clear()

    while at < len(lexemes):
        kind, text = lexemes[at]
        if _near_at(lexemes, at):
            raise QueryError(f"{text} needs a word on its left")
        at += 1
        if kind == "close":
            if not depth:
                return Or(tuple(clauses)), at - 1
            close()
            return Or(tuple(clauses)), at
        if kind == "open":
            if text[0] == "-":
                raise QueryError("a group can't be negated")
            group, at = _query(lexemes, at, depth + 1)
            if group.items:
                items.append(group)
        elif kind == "quote":
            words = tuple(map(_atom, text.strip('-"').split()))
            if words:
                items.append(Literal(Phrase(words) if len(words) > 1 else words[0], text[0] == "-"))
        elif text == "+":
            close()
        else:
            negated = text.startswith("-") and len(text) > 1
            atom = _atom(text[1:] if negated else text)
            if near := _near_at(lexemes, at):
                if near[0][0] == "-" or not _operand(lexemes, at + 1):
                    raise QueryError(f"{near[0]} needs a word on its right, and takes no minus of its own or of that word")
                atom = Near(atom, _atom(lexemes[at + 1][1]), int(near[1]))
                at += 2
            items.append(Literal(atom, negated))
    if depth:
        raise QueryError("a parenthesis isn't closed")
    close()
    return Or(tuple(clauses)), at


def parse(query: str) -> list[Clause]:
    """The OR clauses of a query in disjunctive form, each the AND of its literals. An empty query has none."""
    return _expanded(parse_tree(query))


def _expanded(tree: Or) -> list[Clause]:
    out: list[Clause] = []
    for clause in tree.items:
        each = [[(item,)] if isinstance(item, Literal) else _expanded(item) for item in clause.items]
        out += [tuple(x for part in combination for x in part) for combination in product(*each)]
    return out


def to_dnf(query: str) -> list[str]:
    """The clauses as text."""
    return [" ".join(map(str, clause)) for clause in parse(query)]
