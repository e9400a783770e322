"""Problem 7: passages of evaluation items inside a training corpus.

Each task reads its documents in shards of bounded size and builds an FM-index over the
words of a shard: suffix array, Burrows-Wheeler transform, a wavelet matrix for ranks, and
sampled suffix positions. All windows of ``window`` words of the test items are searched
backward together; the rows left are walked to the next sampled position, which gives
document and word of every occurrence. Overlapping windows are merged into spans. Which
items hold a window is joined to the places only where items are asked for.

Documents aren't shuffled. The test items go to the tasks in blocks of bounded size. With
one block an index is searched as soon as it is built; with more, the indexes are stored
once in the shared folder and every block is searched in the stored ones.

Words are compared by hashes of 64 bits, windows by the words' hashes. A false place needs
a word of the corpus to have the hash of another word of the items, within the same eleven
other words.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.llm.wordstream import mix, words_of
from lexiquarry.workspace import materialize

#: Words of an FM-index; a longer document is cut into pieces that overlap by a window less one word, so none is lost.
SHARD_WORDS = 400_000
#: Words of test items in one block. A worker holds about 100 bytes for each while it searches.
BLOCK_WORDS = 1_000_000
#: Every so many text positions a suffix position is kept.
SAMPLE = 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; a round sorts only the suffixes that the rounds before left equal."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, np.int64)  # of a suffix: where the group of those equal so far starts in the order
    at, key, width = np.arange(n), symbols[order].astype(np.int64), 0
    while len(at):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(starts, len(at)))
        rank[order[at]] = np.repeat(at[starts], size)
        at = at[np.repeat(size > 1, size)]
        width = max(1, 2 * width)
        own = order[at]
        beyond = own + width
        key = rank[own] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[at], key = own[by], key[by]
        if width > n:
            break
    return order


class Bits:
    """A bit vector with ranks."""

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        return cls(np.packbits(padded, bitorder="little").view(np.uint64))

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of position i."""
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Access and rank on a sequence of symbols below ``2 ** levels``, for vectors of arguments."""

    def __init__(self, rows: list[Bits], zeros: list[int]):
        self.levels, self.rows, self.zeros = len(rows), rows, zeros

    @classmethod
    def of(cls, symbols: np.ndarray, levels: int) -> WaveletMatrix:
        rows, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            rows.append(Bits.of(bits))
            zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        return cls(rows, zeros)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in front of its position i."""
        start, i = np.zeros_like(i), i
        for at, (row, zeros) in enumerate(zip(self.rows, self.zeros)):
            one = (symbol >> (self.levels - 1 - at) & 1).astype(bool)
            a, b = row.rank(start), row.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for row, zeros in zip(self.rows, self.zeros):
            one = row.get(i).astype(bool)
            a = row.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + a, i - a)
        return symbol


class FMIndex:
    """Full-text index over pieces of text given as hashes of words."""

    _ARRAYS = ("n", "starts", "vocabulary", "before", "zeros", "positions", "docs", "firsts")

    @classmethod
    def of(cls, pieces: list[np.ndarray], docs: list[int], firsts: list[int]) -> FMIndex:
        """``docs`` and ``firsts``: each piece's document, and the number there of its first word."""
        self = cls()
        self.docs, self.firsts = np.array(docs, np.int64), np.array(firsts, np.int64)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        self.starts = ends - [len(p) + 1 for p in pieces]
        self.n = int(ends[-1])
        self.vocabulary, codes = np.unique(np.concatenate(pieces), return_inverse=True)
        text = np.zeros(self.n, np.int64)  # 0 ends a piece; words from 1
        inside = np.ones(self.n, bool)
        inside[ends - 1] = False
        text[inside] = codes + 1
        order = text + len(pieces)  # for sorting every end is a symbol of its own, so no match runs over it
        order[ends - 1] = np.arange(len(pieces))
        array = suffix_array(order)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))))
        self.matrix = WaveletMatrix.of(text[array - 1], max(1, len(self.vocabulary).bit_length()))
        kept = array % SAMPLE == 0
        first = np.zeros(self.n, bool)
        first[self.starts] = True  # so that no walk leaves its piece
        kept |= first[array]
        self.kept, self.positions = Bits.of(kept), array[kept]
        return self

    def save(self) -> bytes:
        out = io.BytesIO()
        arrays = {a: np.asarray(getattr(self, a)) for a in self._ARRAYS if a != "zeros"}
        np.savez(out, **arrays, zeros=np.array(self.matrix.zeros), kept=self.kept.words, **{f"row{i}": r.words for i, r in enumerate(self.matrix.rows)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> FMIndex:
        self = cls()
        with np.load(io.BytesIO(raw)) as there:
            for a in cls._ARRAYS:
                setattr(self, a, there[a])
            self.n, self.kept = int(self.n), Bits(there["kept"])
            self.matrix = WaveletMatrix([Bits(there[f"row{i}"]) for i in range(len(self.zeros))], self.zeros.tolist())
        return self

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The symbols of words, -1 for words that don't occur."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, -1)

    def search(self, symbols: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pattern, text position) of every occurrence of the runs of ``width`` symbols that begin at ``starts``."""
        missing = np.concatenate(([0], np.cumsum(symbols < 0)))
        alive = np.flatnonzero(missing[starts + width] == missing[starts])
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for column in range(width - 1, -1, -1):
            symbol = symbols[starts[alive] + column]
            low, high = (self.before[symbol] + self.matrix.rank(symbol, x) for x in (low, high))
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
        count = high - low
        rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return np.repeat(alive, count), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, walked = np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            kept = self.kept.get(rows).astype(bool)
            found[open_[kept]] = self.positions[self.kept.rank(rows[kept])] + walked
            open_, rows = open_[~kept], rows[~kept]
            symbol = self.matrix.access(rows)
            rows = self.before[symbol] + self.matrix.rank(symbol, rows)
            walked += 1
        return found


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    out = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for i in range(width):
        out = mix(out + _STEP + hashes[i : i + len(out)])
    return out


class Phrases:
    """The distinct windows of some test items: their words, end to end, where each window starts, and its hash."""

    def __init__(self, items: list[np.ndarray], window: int):
        words = np.concatenate(items) if items else np.zeros(0, np.uint64)
        self.window = window
        self.vocabulary, self.words = np.unique(words, return_inverse=True)
        self.words = self.words.astype(np.int32)
        hashes = windows(words, window)
        first = np.cumsum([0, *map(len, items)])
        whole = np.zeros(len(hashes), bool)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            whole[a : max(b - window + 1, a)] = True
        starts = np.flatnonzero(whole)
        self.hashes, at = np.unique(hashes[starts], return_index=True)
        self.starts = starts[at]

    def find(self, index: FMIndex) -> pd.DataFrame:
        """(doc, phrase, word): every place of a window in the documents of an index."""
        pattern, position = index.search(index.numbers(self.vocabulary)[self.words], self.starts, self.window)
        piece = np.searchsorted(index.starts, position, side="right") - 1
        return pd.DataFrame({"doc": index.docs[piece], "phrase": self.hashes[pattern].view(np.int64), "word": index.firsts[piece] + position - index.starts[piece]})


_PLACES = "doc long, phrase long, word long"


def _indexes(batches: Iterator[pd.DataFrame], window: int, shard_words: int) -> Iterator[FMIndex]:
    """An index for each shard of the documents (doc, text) of a task."""
    step = max(shard_words, window)
    pieces: list[np.ndarray] = []
    docs: list[int] = []
    firsts: list[int] = []
    size = 0
    for batch in batches:
        ids = batch["doc"].tolist()
        for first, ws in words_of(batch["text"].tolist()):
            cuts = ws.offsets.tolist()
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                for at in range(0, b - a - window + 1, step):
                    pieces.append(ws.hashes[a + at : min(b, a + at + step + window - 1)])
                    docs.append(ids[first + i])
                    firsts.append(at)
                    size += len(pieces[-1])
                    if size >= shard_words:
                        yield FMIndex.of(pieces, docs, firsts)
                        pieces, docs, firsts, size = [], [], [], 0
    if pieces:
        yield FMIndex.of(pieces, docs, firsts)


def occurrences(
    documents: DataFrame, items: DataFrame, document: str = "doc_id", text: str = "text", window: int = 12, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(<document>, phrase LONG, word LONG): every place where ``window`` consecutive words of an item stand in a document.

    ``phrase`` is the hash of the window, as in :func:`item_phrases`; ``word`` is the number
    of the first word, from 0, among the words as seen of the document's text. Null ids or
    texts and texts of fewer words give no rows; a document id that occurs twice gives its
    rows twice; extra columns are ignored. The items are read on the driver a row at a time
    and sent in blocks of at most ``block_words`` words (or of one item), so what is
    broadcast stays bounded however many items there are; every document is read, and its
    index built, once.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(document).cast("long").alias("doc"), F.col(text).alias("text")).dropna()
    shared: list = []
    block: list[np.ndarray] = []
    size = 0

    def close() -> None:
        phrases = Phrases(block, window)
        if len(phrases.starts):
            shared.append(spark.sparkContext.broadcast(phrases))

    for row in items.select(text).dropna().toLocalIterator():
        words = np.concatenate([ws.hashes for _, ws in words_of([row[0]])])
        if block and size + len(words) > block_words:
            close()
            block, size = [], 0
        block.append(words)
        size += len(words)
    close()

    def build_and_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (shared[0].value.find(index) for index in _indexes(batches, window, shard_words))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (pd.DataFrame({"index": [index.save()]}) for index in _indexes(batches, window, shard_words))

    def find(phrases) -> Callable:
        return lambda batches: (phrases.value.find(FMIndex.load(raw)) for batch in batches for raw in batch["index"])

    if not shared:
        out = spark.createDataFrame([], _PLACES)
    elif len(shared) == 1:
        out = docs.mapInPandas(build_and_find, _PLACES)
    else:
        stored = materialize(docs.mapInPandas(build, "index binary"), "indexes")
        out = reduce(DataFrame.unionAll, [stored.mapInPandas(find(phrases), _PLACES) for phrases in shared])
        out = out.distinct()  # a window can lie in several blocks
    return out.toDF(document, "phrase", "word")


def item_phrases(items: DataFrame, item: str = "item_id", text: str = "text", window: int = 12) -> DataFrame:
    """(<item>, phrase LONG): the distinct windows of each item; rows with a null id or text have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["item"].to_numpy()
            for first, ws in words_of(batch["text"].tolist()):
                each = [np.unique(windows(ws.hashes[a:b], window)) for a, b in zip(ws.offsets[:-1], ws.offsets[1:])]
                yield pd.DataFrame({"item": np.repeat(ids[first : first + len(each)], [len(x) for x in each]), "phrase": np.concatenate(each).view(np.int64)})

    rows = items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).dropna()
    return rows.mapInPandas(cut, "item long, phrase long").toDF(item, "phrase")


def leaks(found: DataFrame, phrases: DataFrame, document: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(<document>, <item>): which documents hold passages of which items, each pair once.

    Windows that the same items hold, as those of one passage, are one class, told by a sum
    of hashes of the items; documents meet classes before classes are unfolded into items.
    """
    held = phrases.distinct()
    sums = held.groupBy("phrase").agg(F.count("*").alias("_n"), F.sum(F.xxhash64(item).cast("decimal(20,0)")).alias("_sum"))
    classes = sums.select("phrase", F.xxhash64("_n", "_sum").alias("_class"))
    members = held.join(classes, "phrase").select("_class", item).distinct()
    in_documents = found.select(document, "phrase").distinct().join(classes, "phrase").select(document, "_class").distinct()
    return in_documents.join(members, "_class").select(document, item).distinct()


def removal_spans(found: DataFrame, document: str = "doc_id", window: int = 12) -> DataFrame:
    """(<document>, first_word LONG, last_word LONG): merged spans of words to remove, overlapping or adjacent ones as one."""
    starts = found.select(F.col(document), F.col("word")).distinct()
    order = Window.partitionBy(document).orderBy("word")
    before = F.lag("word").over(order)
    opens = F.when(before.isNull() | (F.col("word") > before + window), 1).otherwise(0)
    numbered = starts.withColumn("_open", opens).withColumn("_span", F.sum("_open").over(order))
    return numbered.groupBy(document, "_span").agg(F.min("word").alias("first_word"), (F.max("word") + window - 1).alias("last_word")).drop("_span")
