"""Problem 8: the subject areas of each document.

A sentence is the mean of the embeddings of its words, each the sum of a word vector and
the mean of its subword vectors, both from hashed tables; one independent logistic output
per subject reads it. Training runs over the sentences of a bounded sample of labelled
documents, each sentence with the subjects of its document: in every step each partition
computes the gradient over its share, the gradients are summed, and all continue from the
same parameters. Then each sentence gets the subjects that the model tells for it alone,
or none, since a labelled document has sentences on other subjects too, and training goes
on. A sentence is about every subject whose output passes a level; a document has the
subjects whose sentences hold at least a given share of its words.

Words are whole, however long: subwords are all runs of the given lengths between the
word's end marks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.wordstream import Words, mix, words_of
from lexiquarry.workspace import materialize


class Settings(NamedTuple):
    """What training and scoring depend on."""

    max_labelled: int = 6000  #: labelled documents in the sample
    cells: int = 1 << 14  #: rows of each hashed table
    size: int = 16  #: of an embedding
    grams: tuple[int, int] = (3, 5)  #: shortest and longest subword; the shortest must be 3 or less, so that every word has one
    steps: int = 16  #: on the labels of the documents
    refined: int = 16  #: on each sentence's own subjects, as told after these
    rate: float = 0.12
    decay: float = 1e-6
    partitions: int = 3  #: shares of the sample; each sends a gradient of the model's size in every step
    level: float = 0.5  #: least output of a sentence about a subject
    share: float = 0.25  #: of a document's words
    seed: int = 7


_STEP = np.uint64(0x9E3779B97F4A7C15)


def cells_of(ws: Words, which: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chosen words: the cell of each, the cells of all their subwords, and how many each has; a subword counts as often as it occurs."""
    lengths = ws.lengths[which] + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    letters = np.zeros(int(lengths.sum()), np.uint64)
    inside = np.ones(len(letters), bool)
    inside[starts] = inside[ends - 1] = False
    place = np.arange(len(letters)) - np.repeat(starts, lengths) - 1 + np.repeat(ws.starts[which], lengths)
    letters[inside] = ws.letters[place[inside]]
    letters[starts], letters[ends - 1] = ord("<"), ord(">")
    owner = np.repeat(np.arange(len(which)), lengths)
    cells, of = [], []
    for n in range(s.grams[0], s.grams[1] + 1):
        window = np.full(max(len(letters) - n + 1, 0), n, np.uint64)
        for j in range(n):
            window = mix(window + _STEP + letters[j : j + len(window)])
        whole = np.flatnonzero(np.arange(len(window)) + n <= ends[owner[: len(window)]])
        cells.append((window[whole] % np.uint64(s.cells)).astype(np.int64))
        of.append(owner[whole])
    order = np.argsort(np.concatenate(of), kind="stable")
    words = (mix(ws.hashes[which] + _STEP) % np.uint64(s.cells)).astype(np.int64)
    return words, np.concatenate(cells)[order], np.bincount(np.concatenate(of), minlength=len(which))


class Model(NamedTuple):
    word: np.ndarray
    gram: np.ndarray
    out: np.ndarray  # subjects x size
    bias: np.ndarray

    @staticmethod
    def start(n_subjects: int, s: Settings) -> Model:
        draw = np.random.default_rng(s.seed)
        tables = [draw.normal(0, 0.1, (s.cells, s.size)).astype(np.float32) for _ in range(2)]
        return Model(*tables, draw.normal(0, 0.1, (n_subjects, s.size)).astype(np.float32), np.full(n_subjects, -2.0, np.float32))


def type_vectors(model: Model, word: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(word):
        return np.zeros((0, model.word.shape[1]), np.float32)
    return model.word[word] + np.add.reduceat(model.gram[grams], np.cumsum(counts) - counts) / counts[:, None].astype(np.float32)


def sentence_starts(ws: Words) -> np.ndarray:
    """The number of the first word of each sentence."""
    return np.flatnonzero(np.concatenate(([True], ws.sentences[1:] != ws.sentences[:-1]))) if len(ws.sentences) else np.zeros(0, np.int64)


class Share:
    """A partition's sentences as arrays, which is what :meth:`save` keeps."""

    _ARRAYS = ("tokens", "starts", "counts", "owner", "targets", "word", "gram_counts", "grams")

    @classmethod
    def of(cls, texts: list[str | None], targets: np.ndarray, s: Settings) -> Share:
        """``targets``: a row of 0 and 1 per text, a column per subject."""
        self = cls()
        known = np.zeros(0, np.uint64)
        hashes, starts, about, cells, n = [known], [np.zeros(0, np.int64)], [np.zeros((0, targets.shape[1]), np.float32)], [], 0
        for first, ws in words_of(texts):
            hashes.append(ws.hashes)
            begin = sentence_starts(ws)
            starts.append(begin + n)
            about.append(targets[first + np.searchsorted(ws.offsets, begin, side="right") - 1].astype(np.float32))
            n += len(ws.hashes)
            types, at = np.unique(ws.hashes, return_index=True)
            new = ~np.isin(types, known)
            cells.append((types[new], *cells_of(ws, at[new], s)))
            known = np.union1d(known, types)
        types, word, grams, gram_counts = (np.concatenate(x) for x in zip(*cells)) if cells else (known, *[np.zeros(0, np.int64)] * 3)
        order = np.argsort(types)
        self.tokens = order[np.searchsorted(types[order], np.concatenate(hashes))] if n else np.zeros(0, np.int64)
        self.starts = np.concatenate(starts)
        self.counts = np.diff(np.append(self.starts, n)).astype(np.float32)
        self.owner = np.repeat(np.arange(len(self.starts)), self.counts.astype(np.int64))
        self.targets = np.concatenate(about)
        self.word, self.grams, self.gram_counts = word, grams, gram_counts
        return self

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{a: getattr(self, a) for a in self._ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Share:
        self = cls()
        with np.load(io.BytesIO(raw)) as kept:
            for a in cls._ARRAYS:
                setattr(self, a, kept[a])
        return self

    def outputs(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Mean embedding and logistic outputs of each sentence."""
        vectors = type_vectors(model, self.word, self.grams, self.gram_counts)
        mean = np.add.reduceat(vectors[self.tokens], self.starts) / self.counts[:, None]
        return mean, 1 / (1 + np.exp(-(mean @ model.out.T + model.bias)))

    def refine(self, model: Model, base: np.ndarray) -> None:
        """Let each sentence be about the subjects whose output is beyond half way from the subject's base rate to certainty, each by itself.

        A sentence that tells nothing of a subject gets about its base rate, however high that is.
        """
        if len(self.starts):
            self.targets = (self.outputs(model)[1] >= (1 + base) / 2).astype(np.float32)

    def gradient(self, model: Model) -> tuple[list[np.ndarray], float]:
        """Sums over the share's sentences, not means."""
        if not len(self.starts):
            return [np.zeros_like(p) for p in model], 0.0
        mean, p = self.outputs(model)
        loss = float(-(self.targets * np.log(p + 1e-9) + (1 - self.targets) * np.log(1 - p + 1e-9)).sum())
        error = p - self.targets
        by_sentence = error @ model.out / self.counts[:, None]
        size = model.word.shape[1]
        by_type = np.stack([np.bincount(self.tokens, weights=by_sentence[self.owner, d], minlength=len(self.word)) for d in range(size)], 1)
        word, gram = np.zeros(model.word.shape), np.zeros(model.gram.shape)
        np.add.at(word, self.word, by_type)
        np.add.at(gram, self.grams, np.repeat(by_type / self.gram_counts[:, None], self.gram_counts, axis=0))
        return [x.astype(np.float32) for x in (word, gram, error.T @ mean, error.sum(0))], loss


class Adam:
    def __init__(self, model: Model, s: Settings):
        self.s, self.t = s, 0
        self.m, self.v = ([np.zeros_like(p) for p in model] for _ in range(2))

    def step(self, model: Model, gradient: list[np.ndarray]) -> Model:
        self.t += 1
        out = []
        for i, (p, g) in enumerate(zip(model, gradient)):
            g = g + self.s.decay * p
            self.m[i] += 0.1 * (g - self.m[i])
            self.v[i] += 0.01 * (g * g - self.v[i])
            m, v = self.m[i] / (1 - 0.9**self.t), self.v[i] / (1 - 0.99**self.t)
            out.append((p - self.s.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
        return Model(*out)


def _sample(documents: DataFrame, labels: DataFrame, names: list[str], s: Settings) -> DataFrame:
    """(part INT, share BINARY): the bounded sample of labelled documents as arrays, a row per share.

    Labels are compared without case and outer blanks; null and unknown ones are left out, repeated ones count once.
    """
    known = F.array_position(F.array(*[F.lit(n.strip().lower()) for n in names]), F.lower(F.trim("subject"))).cast("int")
    of_doc = labels.select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("no")).filter("no > 0 AND doc_id IS NOT NULL")
    # At most as many rows as there are subjects go into a set.
    chosen = of_doc.groupBy("doc_id").agg(F.collect_set("no").alias("nos")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna().join(F.broadcast(chosen), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(s.partitions)).cast("int")
    n = len(names)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        targets = np.stack([np.isin(np.arange(1, n + 1), nos) for nos in pdf["nos"]])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "share": [Share.of(pdf["text"].tolist(), targets, s).save()]})

    # A share holds max_labelled / partitions documents on average, whatever the corpus.
    return rows.select(part.alias("part"), "doc_id", "text", "nos").groupBy("part").applyInPandas(make, "part int, share binary")


def train(documents: DataFrame, labels: DataFrame, names: list[str], settings: Settings = Settings()) -> Model | None:
    """Fit the model; None if no labelled document has words. What reaches the driver is one gradient per share and step."""
    spark, s = documents.sparkSession, settings
    shares = materialize(_sample(documents, labels, names, s), "subject-shares")
    model = Model.start(len(names), s)
    shapes = [p.shape for p in model]
    ends = np.cumsum([p.size for p in model])

    def gradients(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part, raw in zip(batch["part"], batch["share"]):
                    share = Share.load(raw)
                    gradient, loss = share.gradient(shared.value)
                    yield pd.DataFrame({"part": [part], "n": [len(share.starts)], "loss": [loss], "held": [share.targets.sum(0).tolist() if len(share.starts) else [0.0] * len(names)], "gradient": [np.concatenate([g.ravel() for g in gradient]).tobytes()]})

        return run

    def refined(shared, base: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part, raw in zip(batch["part"], batch["share"]):
                    share = Share.load(raw)
                    share.refine(shared.value, base)
                    yield pd.DataFrame({"part": [part], "share": [share.save()]})

        return run

    adam, base = Adam(model, s), np.zeros(len(names))
    for step in range(s.steps + s.refined):
        shared = spark.sparkContext.broadcast(model)
        if step == s.steps:
            shares = materialize(shares.mapInPandas(refined(shared, base), "part int, share binary"), "subject-shares")
        # In the order of the shares, so that the sums don't depend on which task ends first.
        rows = sorted(shares.mapInPandas(gradients(shared), "part int, n long, loss double, held array<double>, gradient binary").collect())
        n = sum(r["n"] for r in rows)
        if not n:
            return None
        total = np.zeros(int(ends[-1]))
        for r in rows:
            total += np.frombuffer(r["gradient"], np.float32)
        total /= n
        base = sum(np.array(r["held"]) for r in rows) / n
        model = adam.step(model, [g.reshape(shape).astype(np.float32) for g, shape in zip(np.split(total, ends[:-1]), shapes)])
        shared.destroy()
    return model


class Scorer:
    """Subjects of texts; a worker's vectors of words are kept between batches, and start anew beyond ``most``."""

    def __init__(self, model: Model, s: Settings, most: int = 200_000):
        self.model, self.s, self.most = model, s, most
        self._clear()

    def _clear(self) -> None:
        self.types, self.vectors = np.zeros(0, np.uint64), np.zeros((0, self.s.size), np.float32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.types, hashes), max(len(self.types) - 1, 0))
        return at, self.types[at] == hashes if len(self.types) else np.zeros(len(hashes), bool)

    def _numbers(self, ws: Words) -> np.ndarray:
        """The row of each word's vector."""
        at, there = self._find(ws.hashes)
        if there.all():
            return at
        missing = np.flatnonzero(~there)
        new, first = np.unique(ws.hashes[missing], return_index=True)
        own = type_vectors(self.model, *cells_of(ws, missing[first], self.s)).astype(np.float32)
        order = np.argsort(types := np.concatenate((self.types, new)))
        self.types, self.vectors = types[order], np.concatenate((self.vectors, own))[order]
        return self._find(ws.hashes)[0]

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """For each text and subject the share of words in sentences about it; 0 for a text without words."""
        out = np.zeros((len(texts), len(self.model.bias)))
        for first, ws in words_of(texts):
            if not len(ws.hashes):
                continue
            if len(self.types) > self.most:
                self._clear()
            starts = sentence_starts(ws)
            counts = np.diff(np.append(starts, len(ws.hashes)))
            numbers = self._numbers(ws)
            mean = np.add.reduceat(self.vectors[numbers], starts) / counts[:, None]
            about = 1 / (1 + np.exp(-(mean @ self.model.out.T + self.model.bias))) >= self.s.level
            owner = np.searchsorted(ws.offsets, starts, side="right") - 1
            total = np.diff(ws.offsets)
            for subject in range(out.shape[1]):
                held = np.bincount(owner, weights=counts * about[:, subject], minlength=len(total))
                out[first : first + len(total), subject] = held / np.maximum(total, 1)
        return out


def subject_names(subjects: DataFrame) -> list[str]:
    """The subjects, as written, in byte order. A fixed and small table."""
    return sorted({r[0] for r in subjects.select("subject").dropna().collect()})


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, subject STRING, share DOUBLE): each document's subjects that hold at least ``settings.share`` of its words.

    Null and empty texts and texts about no subject give no row; so does everything if
    there are no subjects or no labelled texts. Rows with a null doc_id are left out; a row
    that occurs twice is scored twice; extra columns are ignored. Scoring is one pass
    without a shuffle; the broadcast model has a fixed size.
    """
    spark = documents.sparkSession
    names = subject_names(subjects)
    model = train(documents, labels, names, settings) if names else None
    schema = "doc_id long, subject string, share double"
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value, settings)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                shares = scorer.shares(part["text"].tolist())
                doc, subject = np.nonzero(shares >= settings.share - 1e-9)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[doc], "subject": [names[i] for i in subject], "share": shares[doc, subject]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna().mapInPandas(score, schema)
