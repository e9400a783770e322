"""Words of many texts at once, as numbers.

The texts of a batch are laid end to end as code points and mapped through one table that
says what a character is as seen: nothing, white space, another sign, or a letter or digit
in lower case. Words, sentences and 64-bit hashes of words follow from whole arrays. Only
a text with a character whose reading depends on its neighbours (separate accents and the
like) is first brought to its form by :mod:`lexiquarry.llm.seen`. The words are exactly
those of :func:`lexiquarry.llm.seen.words`.

Two different words have one hash with a chance of 2**-64.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from lexiquarry.llm import seen

#: Characters mapped at a time, or one text; bounds the arrays of a worker.
CHARACTERS = 500_000

_GONE, _OTHER, _LINE, _STOP, _WHITE, _FULL_STOP, _LETTER = 0, 1, 2, 3, 4, 5, 8  # from _LETTER on: the letter's code point, as none lies below
_LINES = re.compile("[\n\r\u0085\u2028\u2029]+")

_PAGE = 256
_CONTEXT = np.zeros(0x110000, bool)  # whose reading depends on neighbours
_CLASS = np.zeros(0x110000, np.uint32)
_BUILT = np.zeros(0x110000 // _PAGE, bool)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _of_character(c: int) -> tuple[bool, int]:
    """Whether its reading depends on neighbours, and its class or lower-case letter."""
    ch = chr(c)
    if seen.is_blank(ch):
        return False, _GONE
    shown = seen.letter_seen(ch)
    lower = shown.lower()
    alone = len(lower) == 1 and shown != "Σ" and unicodedata.normalize("NFC", ch) == ch and not unicodedata.category(ch).startswith("M") and not 0x1100 <= c < 0x1200
    if ch in "\n\r\u0085\u2028\u2029":
        return False, _LINE
    if seen.is_space(ch):
        return False, _WHITE
    if shown in ".!?":
        return False, _STOP
    if ch == "。":
        return False, _FULL_STOP
    return not alone, ord(lower[0]) if lower[0].isalnum() else _OTHER


def _build(points: np.ndarray) -> None:
    pages = np.flatnonzero(np.bincount(points // _PAGE, minlength=len(_BUILT)) * ~_BUILT)
    for page in pages.tolist():
        for c in range(page * _PAGE, (page + 1) * _PAGE):
            _CONTEXT[c], _CLASS[c] = _of_character(c)
        _BUILT[page] = True


class Words(NamedTuple):
    """The words of some texts in order."""

    hashes: np.ndarray  #: uint64, a word each
    offsets: np.ndarray  #: where each text's words start, and where the last one's end
    sentences: np.ndarray  #: a number per word that grows with each new sentence or text
    letters: np.ndarray  #: code points of all words
    starts: np.ndarray  #: where each word starts among the letters
    lengths: np.ndarray

    def spelt(self, word: int) -> str:
        at = self.starts[word]
        return self.letters[at : at + self.lengths[word]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a line break behind each, and where each ends."""
    points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([len(t) + 1 for t in texts])


def _words(texts: list[str]) -> Words:
    points, ends = _points(texts)
    _build(points)
    context = _CONTEXT[points]
    if context.any():
        texts = list(texts)
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(context), side="right")).tolist():
            texts[i] = "\n".join(seen.as_seen(line).lower() for line in _LINES.split(texts[i]))
        points, ends = _points(texts)
        _build(points)
    codes = _CLASS[points]
    at = np.flatnonzero(codes)
    codes = codes[at]
    letter = codes >= _LETTER
    before = np.concatenate(([False], letter[:-1]))
    first = np.flatnonzero(letter & ~before)
    last = np.flatnonzero(before & ~letter)  # a line break ends every text, so no word is open at the end
    lengths = last - first
    opens = (codes == _LINE) | (codes == _FULL_STOP)
    opens[1:] |= (codes[1:] == _WHITE) & (codes[:-1] == _STOP)
    sentences = np.cumsum(opens)[first]
    offsets = np.concatenate(([0], np.searchsorted(at[first], ends, side="left")))
    letters = codes[letter]
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    own = mix(letters.astype(np.uint64) * _A + place * _C)
    sums = np.add.reduceat(own, starts) if len(starts) else np.zeros(0, np.uint64)
    return Words(mix(sums + lengths.astype(np.uint64)), offsets, sentences, letters, starts, lengths)


def words_of(texts: list[str | None], characters: int = CHARACTERS) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) of chunks of consecutive texts, each of at most so many characters or of one text; null is an empty text."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and size + n > characters:
            yield begin, _words([t or "" for t in texts[begin:i]])
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, _words([t or "" for t in texts[begin:]])
