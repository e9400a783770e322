import random

import numpy as np

from lexiquarry.llm import subjects as s
from lexiquarry.llm.wordstream import words_of

TOPICS = {"Sea": "wave tide ship sailor harbour reef".split(), "Oven": "bread dough flour crust yeast baker".split(), "Stars": "comet orbit nebula galaxy lens planet".split()}
FILLER = "the a of in and it was there then so".split()
SETTINGS = s.Settings(max_labelled=200, cells=1 << 10, size=8, partitions=2)


def sentence(draw, topic=None):
    ws = [draw.choice(FILLER) for _ in range(5)] + ([draw.choice(TOPICS[topic]) for _ in range(5)] if topic else [draw.choice(FILLER) for _ in range(5)])
    draw.shuffle(ws)
    return " ".join(ws).capitalize() + draw.choice([".", "!", "?"])


def corpus(draw, n):
    docs, truth = [], {}
    for i in range(n):
        about = draw.sample(list(TOPICS), draw.choice([0, 1, 1, 2]))
        plan = [t for t in about for _ in range(4)] + [None] * draw.choice([1, 3])
        draw.shuffle(plan)
        docs.append((i, draw.choice(["\n", " "]).join(sentence(draw, t) for t in plan)))
        truth[i] = {t for t in about if 4 / len(plan) >= 0.25}
    return docs, truth


def test_held_out_documents(spark):
    draw = random.Random(1)
    docs, truth = corpus(draw, 400)
    labelled = [i for i in range(0, 400, 2) if truth[i]]
    rows = [(i, draw.choice([t, t.upper(), f" {t} "])) for i in labelled for t in truth[i]]
    rows += rows[:20] + [(1, None), (None, "Sea"), (3, "unknown"), (999, "Sea")]
    for i in labelled[:5]:  # a few wrong labels
        rows.append((i, draw.choice(list(TOPICS))))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, sentence(draw, "Sea")), (1003, "..."), (1004, "wave tide ship reef. " * 20_000)]
    frames = (
        spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, subject string, share double"),
        spark.createDataFrame(rows, "doc_id long, subject string"),
        spark.createDataFrame([(t, "about") for t in TOPICS] + [(None, "x")], "subject string, about string"),
    )
    got = {}
    for r in s.document_subjects(*frames, SETTINGS).collect():
        got.setdefault(r.doc_id, {})[r.subject] = r.share
    assert got.pop(1004) == {"Sea": 1.0} and not {None, 1000, 1001, 1002, 1003} & set(got)
    held_out = [i for i in range(1, 400, 2)]
    right = sum(set(got.get(i, {})) == truth[i] for i in held_out)
    assert right >= 0.9 * len(held_out), right
    assert all(0.25 <= x <= 1 for d in got.values() for x in d.values())
    again = {(r.doc_id, r.subject) for r in s.document_subjects(*frames, SETTINGS).collect()} - {(1004, "Sea")}
    assert again == {(d, x) for d, v in got.items() for x in v}  # the same model again


def test_nothing_to_learn_from_or_to_score(spark):
    docs = spark.createDataFrame([(1, "wave.")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "Sea")], "doc_id long, subject string")
    names = spark.createDataFrame([("Sea",)], "subject string")
    assert s.document_subjects(docs, labels.limit(0), names, SETTINGS).collect() == []
    assert s.document_subjects(docs, labels, names.limit(0), SETTINGS).collect() == []
    assert s.document_subjects(docs.limit(0), labels, names, SETTINGS).collect() == []


def test_words_are_taken_whole():
    """Words that differ only behind their 64th letter have other subwords, and a long word has all of its own."""
    settings = s.Settings(cells=1 << 20)
    long = "wave" * 20
    ((_, ws),) = words_of([f"{long}tide {long}crust a {long * 500}"])
    word, grams, counts = s.cells_of(ws, np.arange(4), settings)
    assert len(set(word)) == 4 and counts.tolist() == [3 * (len(w) + 2) - 9 for w in (f"{long}tide", f"{long}crust")] + [1] + [3 * 40_002 - 9]
    first, second = (set(x) for x in np.split(grams, np.cumsum(counts))[:2])
    assert first - second and second - first and len(first & second) > 8


def test_a_sentence_on_two_subjects():
    """Outputs are read independently: a sentence counts for each subject whose output passes the level."""
    settings = s.Settings(cells=256, size=2, level=0.5)
    model = s.Model(np.zeros((256, 2), np.float32), np.zeros((256, 2), np.float32), np.eye(2, dtype=np.float32) * 50, np.full(2, -10, np.float32))
    ((_, ws),) = words_of(["wave bread it"])
    for at, vector in ((0, (1, 0)), (1, (0, 1))):
        model.word[s.cells_of(ws, np.array([at]), settings)[0]] = vector
    assert s.Scorer(model, settings).shares(["wave bread. it it", "wave wave. bread", "it", None]).tolist() == [[0.5, 0.5], [2 / 3, 1 / 3], [0, 0], [0, 0]]
    share = s.Share.of(["wave bread. it it"], np.array([[1, 0]]), settings)
    share.refine(model, np.array([0.1, 0.1]))
    assert share.targets.tolist() == [[1, 1], [0, 0]]


def test_vectors_start_anew_without_changing_results():
    settings = s.Settings(cells=512, size=4)
    model = s.Model.start(3, settings)
    texts = [f"word{i} other{i}. more{i % 3} word{i}" for i in range(50)]
    together = s.Scorer(model, settings).shares(texts)
    apart = s.Scorer(model, settings, most=5)
    assert np.allclose(np.concatenate([apart.shares([t]) for t in texts]), together)


def test_gradient_by_differences():
    settings = s.Settings(cells=64, size=4)
    draw = random.Random(0)
    share = s.Share.of([sentence(draw, "Sea"), sentence(draw, "Oven")], np.eye(2), settings)
    share = s.Share.load(share.save())
    model = s.Model(*[p.astype(np.float64) for p in s.Model.start(2, settings)])
    gradient, _ = share.gradient(model)
    for part in range(4):
        flat = np.abs(gradient[part]).ravel().argsort()[-5:]
        for at in flat:
            losses = []
            for step in (1e-4, -1e-4):
                moved = [p.copy() for p in model]
                moved[part].reshape(-1)[at] += step
                losses.append(share.gradient(s.Model(*moved))[1])
            assert abs((losses[0] - losses[1]) / 2e-4 - gradient[part].ravel()[at]) < 1e-3


def test_shares_add_up():
    """Gradients of parts sum to the gradient of the whole."""
    settings = s.Settings(cells=64, size=4)
    docs, truth = corpus(random.Random(4), 12)
    texts, targets = [t for _, t in docs], np.array([[x in truth[i] for x in TOPICS] for i, _ in docs])
    model = s.Model.start(3, settings)
    whole = s.Share.of(texts, targets, settings).gradient(model)[0]
    parts = [s.Share.of(texts[i::3], targets[i::3], settings).gradient(model)[0] for i in range(3)]
    for w, *p in zip(whole, *parts):
        assert np.allclose(w, sum(p), atol=1e-4)
    assert not any(g.any() for g in s.Share.of([], np.zeros((0, 3)), settings).gradient(model)[0])
