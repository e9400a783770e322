import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiquarry.llm import seen
from lexiquarry.llm.wordstream import words_of

SIGNS = ["Σ", "ς", "İ", "ß", "é", "é", "́", "ͅ", "ᄀ", "ᅡ", "ᆨ", "가", "K", "Å", "Ａ", "１", "．", "！", "。", "？", "А", "​", "­", "　", " ", "\u0085", "\r\n", "²", "½", "_", "-", "क्षे", "🔥", "𝐀", "ﬁ", "ǅ", ".", "! ", "? ", " ", "\n", "a", "B", "z9"]
TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=20), st.lists(st.sampled_from(SIGNS), max_size=14).map("".join)), max_size=6)


def sentences(text):
    """The words of each sentence; lines and the marks . ! ? end sentences, those without words are left out."""
    lines = re.split("[\n\r\u0085\u2028\u2029]+", text or "")
    return [ws for line in lines for part in re.split(r"(?<=[.!?])\s+|(?<=。)", seen.as_seen(line)) if (ws := seen.words_seen(part))]


def spelt(texts, characters):
    out = [[] for _ in texts]
    apart = [[] for _ in texts]
    for first, w in words_of(texts, characters):
        for i in range(len(w.offsets) - 1):
            last = None
            for k in range(w.offsets[i], w.offsets[i + 1]):
                out[first + i].append(w.spelt(k))
                if w.sentences[k] != last:
                    apart[first + i].append([])
                    last = w.sentences[k]
                apart[first + i][-1].append(w.spelt(k))
    return out, apart


@settings(max_examples=600, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_and_sentences_are_those_of_each_text(texts, characters):
    plain, apart = spelt(texts, characters)
    assert plain == [seen.words(t) for t in texts]
    assert apart == [sentences(t) for t in texts]


def test_hashes_tell_words_apart():
    ws = [f"{a}{b}{c}" for a in "abcdefghij" for b in ("", *"abcdefghij") for c in ("", *"xyz09")] + ["ab" * 600, "ba" * 600, "é", "e"]
    ((_, w),) = words_of([" ".join(ws)], 10**6)
    assert len(np.unique(w.hashes)) == len(set(ws)) and (w.hashes == next(words_of([" ".join(ws).upper()], 10**6))[1].hashes).all()
    assert list(words_of([])) == [] and next(words_of([None, ""]))[1].offsets.tolist() == [0, 0, 0]


def test_sentences_by_hand():
    text = "One two. Three 3.5 four!\nfive\r\n\r\nSix？ seven"
    assert spelt([text], 10**6)[1] == [[["one", "two"], ["three", "3", "5", "four"], ["five"], ["six"], ["seven"]]]
    assert sentences(None) == sentences("") == sentences("... !") == []
