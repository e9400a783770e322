"""Problem 4: near-duplicate records, exactly, without comparing all pairs.

A record is the set of the hashes of its word shingles. Candidates come from prefixes: all
sets order their shingles in one way, rarest first. Two sets R and S of Jaccard similarity
t or more share at least o = t / (1 + t) * (|R| + |S|) shingles, and the first l of those
lie among the first |R| - o + l of R and the first |S| - o + l of S. So pairs that don't
share l shingles of such prefixes can't be similar, whatever the order; l is larger for
larger sets, as hardly any other pair shares several. At a similarity of 0.6 a set is
indexed by a quarter of its shingles and probes smaller ones with two fifths. The order
comes from a histogram of bounded size; it changes the work, never the result. A shingle
alone in its cell of the histogram can't be shared and is left out.

Disk is what this was made for. Only the words of a record are written, as columns with a
dictionary; shingles are made from them again when they are needed. Prefixes travel as
packed arrays, a partition's rows of many sets in one value, and are joined as arrays of
numbers. Each step's shuffle files are removed when it ends. Large tables are probed in
several passes, each with as many sets as the pairs of the passes before allow.

Candidates are checked by a fingerprint that can't reject a similar pair, and then exactly
on the hashes of 64 bits. Equal sets are made one class first, so copies are neither
indexed nor paired. Classes are told apart by 128 bits, shingles by 64: among 10**10 records two different sets fall into one
class with a chance below 10**-18; two shingles of one pair of records of 1,000 shingles
are taken for one with a chance of about 10**-13.

With ``free``, :func:`similar_sets` takes candidates from signatures instead, by universe
partition and pigeonhole, which takes far more disk. Records of one size band split the
universe of shingles into the same number of segments, by hash. Two sets R and S of Jaccard similarity t or more differ in at most
H = (1 - t) / (1 + t) * (|R| + |S|) shingles. Give each segment of R an allowance v: -1 (not
used), 0 (equal segments match) or 1 (segments that differ in one shingle match too). If
the allowances plus one sum up to more than H, a pair within H must match in some segment:
otherwise each segment would hold more than v differences. So no similar pair is lost.

Every set is indexed under its segments, and wide segments of three shingles or more under
their one-deletion neighbourhoods. It probes the bands of its own size and smaller with
the segments and neighbourhoods its allowances ask for. Bands are as wide as the
similarity allows sizes to differ, so two bands are enough. Which segments get which
allowance follows from costs: the sets that share the segment's rarest shingle (for a
neighbourhood, the second rarest), and the signatures to be emitted. Empty segments are
never used, frequent ones are skipped for rare ones. The frequencies come from a histogram
of fixed size over all shingles; they change the work, never the result. A set whose
segments can't reach the sum, as most of its shingles fell together, is compared through its
single shingles instead.

Larger sets choose allowances that sum up to a little more than H + 1. Then one match isn't
enough: the matching segments' allowances plus one must reach the surplus too, which
hardly any pair does that shares but some common phrases.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import groupby
from operator import add, itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.canonical import once
from lexiquarry.llm.seen import visible
from lexiquarry.llm.wordstream import mix, words_of
from lexiquarry.workspace import fits_broadcast, hashed_joins, initial_partitions, materialize, setting

#: Cells of the shingle histogram for signatures: 8 bytes each, whatever the corpus.
CELLS = 1 << 18
#: Fewest and most cells of the histogram that orders shingles; one for four shingles in between.
FEWEST_CELLS, MOST_CELLS = 1 << 12, 1 << 22
#: Pieces in which histograms are added, and most tasks that count.
STRIPS, COUNTING_TASKS = 64, 256
#: Prefix rows that a worker packs at a time, that a partition holds (about), and pairs that it looks at at a time.
PACKED, JOINED, PAIRED = 2_000_000, 500_000, 2_000_000
#: Shingles up to which all sets probe in one pass; slices of the sets for more, and pairs a shingle that a pass may shuffle.
ONE_PASS, SLICES, PAIRS_EACH = 32_000_000, 64, 0.4
#: Largest table of ids that is broadcast.
BROADCAST_BYTES = 32 << 20
#: Expected segments with shingles, for each one that the largest set of a band needs.
FREE = 1.1
#: One segment in so many is wide where the largest sets of the band fill a segment with more than FULL shingles; else all are.
WIDE, FULL = 4, 2.0
#: Most surplus of allowances, and shingles of a set for each of it.
SURPLUS, SHARE = 4, 16
#: Shingles whose signatures a worker makes at a time; bounds its arrays.
SHINGLES = 250_000
#: Signatures to sort in a task.
SORTED_ROWS = 500_000
#: Largest partition that is joined by a hash table instead of sorting; it is measured.
HASHED_BYTES = 32 << 20
#: Words of 64 bits in a fingerprint.
PRINT_WORDS = 8

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _distinct(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, how many each has) of lists of words that lie one behind the other: distinct, and sorted in each; with width 0 the values are shingles."""
    runs = values.copy()
    if width:
        runs = np.zeros(max(len(values) - width + 1, 0), np.uint64)
        for i in range(width):
            runs = mix(runs + _A + values[i : i + len(runs)])
    stops = np.maximum(offsets[1:] - max(width - 1, 0), offsets[:-1])
    kept = np.zeros(len(runs) + 1, bool)
    for a, b in zip(offsets[:-1].tolist(), stops.tolist()):
        if a < b:
            own = runs[a:b]
            own.sort()
            kept[a] = True
            np.not_equal(own[1:], own[:-1], out=kept[a + 1 : b])
    before = np.concatenate(([0], np.cumsum(kept)))
    return runs[kept[:-1]], before[stops] - before[offsets[:-1]]


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), values.view(np.int64))


def _texts(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts])
    return df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), text.alias("text"))


def shingle_sets(df: DataFrame, key: str, parts: list[str], width: int) -> DataFrame:
    """(id, n INT, tokens ARRAY<LONG>): the shingles of the words of the parts joined by spaces; a null part counts as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ws in words_of(batch.column(1).to_pylist()):
                tokens, sizes = _distinct(ws.hashes, ws.offsets, width)
                some = sizes > 0
                ids = batch.column(0).slice(first, len(sizes)).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes[some].astype(np.int32)), _listed(tokens, sizes[some])], names=["id", "n", "tokens"])

    return _texts(df, key, parts).mapInArrow(cut, "id long, n int, tokens array<long>")


_LISTS = "id long, n int, h1 long, h2 long, words array<long>"


def _lists(ids: pa.Array, words: np.ndarray, offsets: np.ndarray, width: int) -> pa.RecordBatch:
    """Lists of words that have shingles, with the number of these and two hashes of their set."""
    tokens, sizes = _distinct(words, offsets, width)
    before = np.concatenate(([0], np.cumsum(sizes)))
    sums = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens + x)))) for x in (_B, _C))
    h1, h2 = ((x[before[1:]] - x[before[:-1]]).view(np.int64) for x in sums)
    some = sizes > 0
    lengths = np.diff(offsets)
    columns = [ids.filter(pa.array(some)), *(pa.array(x[some]) for x in (sizes.astype(np.int32), h1, h2)), _listed(words[np.repeat(some, lengths)], lengths[some])]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n", "h1", "h2", "words"])


def _word_lists(df: DataFrame, key: str, parts: list[str], width: int) -> DataFrame:
    """The words of each record, from which its shingles are made when they are needed: as columns of a file they take a fraction of the shingles' place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ws in words_of(batch.column(1).to_pylist()):
                yield _lists(batch.column(0).slice(first, len(ws.offsets) - 1), ws.hashes, ws.offsets, width)

    return _texts(df, key, parts).mapInArrow(cut, _LISTS)


def _token_lists(sets: DataFrame) -> DataFrame:
    """Sets that are given as shingles, in the form of :func:`_word_lists` with width 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _values(batch.column(1))
            yield _lists(batch.column(0), values, offsets, 0)

    return sets.select(F.col("id").cast("long"), "tokens").mapInArrow(cut, _LISTS)


def _values(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


class Threshold(NamedTuple):
    """The least similarity, as a fraction, so that nothing is rounded."""

    over: int
    under: int

    def differences(self, total):
        """Most differences of two sets with ``total`` shingles together."""
        return (self.under - self.over) * total // (self.under + self.over)


class Bands:
    """Size bands, and the number of segments of each."""

    def __init__(self, limit: Threshold, largest: int, free: float = FREE):
        self.limit = limit
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, lows[-1] * limit.under // limit.over))
        self.lows = np.array(lows)
        self.highs = self.lows[1:] - 1
        self.segments = np.array([self._segments(high, free * (limit.differences(2 * high) + 1) + 2) for high in self.highs.tolist()])
        self.wide_in = np.where(self.highs > FULL * self.segments, WIDE, 1)

    @staticmethod
    def _segments(n: int, wanted: float) -> int:
        """The least number of segments of which n shingles are expected to fill so many; 64 a shingle if that can't be had."""
        most = 64 * n
        if most * -math.expm1(-n / most) < wanted:
            return most
        low, high = 1, most
        while low < high:
            m = (low + high) // 2
            low, high = (low, m) if m * -math.expm1(-n / m) >= wanted else (m + 1, high)
        return low

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, side="right") - 1

    def lowest(self, n: np.ndarray) -> np.ndarray:
        """The lowest band with sets that can be similar to one of size n."""
        return self.of(-(-n * self.limit.over // self.limit.under))

    def needed(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """One more than the differences that a set of size n and one of the band, not larger, can have, and the surplus."""
        return self.limit.differences(n + np.minimum(self.highs[band], n)) + 1 + np.minimum(n // SHARE, SURPLUS)


class _Segmented:
    """The segments with shingles of several sets, each set split as its band says."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, band: np.ndarray, bands: Bands):
        each = bands.segments[band]
        seed = band.astype(np.uint64) * _A
        owner = np.repeat(np.arange(len(sizes)), sizes)
        segment = mix(tokens ^ seed[owner]) % each.astype(np.uint64)[owner]
        key = owner.astype(np.uint64) << np.uint64(32) | segment
        self.order = np.argsort(key)
        key = key[self.order]
        self.starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.starts, len(key)))
        self.of_token = np.repeat(np.arange(len(self.starts)), self.size)  # in the order of ``order``
        self.owner = (key[self.starts] >> np.uint64(32)).astype(np.int64)
        number = key[self.starts] & np.uint64(0xFFFFFFFF)
        self.wide = number % bands.wide_in[band].astype(np.uint64)[self.owner] == 0
        self.weight = mix(tokens[self.order] + _C)
        # A segment's hash is a sum, so that a shingle is taken out by subtracting.
        self.total = np.add.reduceat(self.weight, self.starts) if len(key) else np.zeros(0, np.uint64)
        self.base = mix(seed[self.owner] + (number + np.uint64(1)) * _B)

    def whole(self, chosen: np.ndarray, kind: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(signature, owner) of the chosen segments."""
        return mix(self.total[chosen] + self.base[chosen] ^ kind), self.owner[chosen]

    def without_one(self, chosen: np.ndarray, kind: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(signature, owner) of the chosen segments without each of their shingles."""
        at = np.flatnonzero(chosen[self.of_token])
        of = self.of_token[at]
        return mix(self.total[of] - self.weight[at] + self.base[of] ^ kind), self.owner[of]


_EXACT, _DELETED = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_INDEX = "sig long, s long, ns int"
_PROBE = "sig long, r long, nr int, weight byte"


def index_signatures(tokens: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, ...]:
    """(signature, number of the set) of all sets, whose shingles lie one set behind the other."""
    s = _Segmented(tokens, sizes, bands.of(sizes), bands)
    parts = s.whole(np.ones(len(s.starts), bool), _EXACT), s.without_one(s.wide & (s.size > 2), _DELETED)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _allowances(s: _Segmented, often: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which segments match when equal, which with one difference too, and which sets can't reach their sum."""
    often = often[s.order]
    rarest = np.minimum.reduceat(often, s.starts) if len(often) else often
    first = np.flatnonzero(often == rarest[s.of_token])
    first = first[np.concatenate(([True], s.of_token[first][1:] != s.of_token[first][:-1]))] if len(first) else first
    rest = often.copy()
    rest[first] = np.iinfo(np.int64).max >> 24
    second = np.minimum.reduceat(rest, s.starts) if len(often) else often
    can = np.flatnonzero(s.wide & (s.size > 1))
    zero = rarest + 1
    one = np.maximum(zero + 1, second + 1 + s.size)[can]  # dearer than without the difference, so it is picked after it
    owner = np.concatenate((s.owner, s.owner[can]))
    cost = np.minimum(np.concatenate((zero, one)), (1 << 39) - 1)
    cost[len(zero) :] += 1
    order = np.argsort(owner.astype(np.uint64) << np.uint64(40) | cost.astype(np.uint64))
    options = np.bincount(owner, minlength=len(need))
    place = np.empty(len(owner), np.int64)
    place[order] = np.arange(len(owner)) - np.repeat(np.cumsum(options) - options, options)
    picked = place < need[owner]
    near = np.zeros(len(zero), bool)
    near[can[picked[len(zero) :]]] = True
    return picked[: len(zero)], near, options < need


def probe_signatures(tokens: np.ndarray, sizes: np.ndarray, bands: Bands, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, number of the set, allowance plus one), and for each set whether its segments can't reach the sum in some band."""
    often = cells[(tokens % np.uint64(CELLS)).astype(np.int64)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own, lowest = bands.of(sizes), bands.lowest(sizes)
    short = np.zeros(len(sizes), bool)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8))]
    for down in range(int((own - lowest).max(initial=-1)) + 1):
        some = np.flatnonzero(own - down >= lowest)
        at = (own - down >= lowest)[owner]
        s = _Segmented(tokens[at], sizes[some], own[some] - down, bands)
        equal, near, lacking = _allowances(s, often[at], bands.needed(sizes[some], own[some] - down))
        short[some[lacking]] = True
        found = (s.whole(equal & ~near, _EXACT), 1), (s.whole(near, _EXACT), 2), (s.whole(near, _DELETED), 2), (s.without_one(near, _EXACT), 2)
        parts += [(sig, some[of], np.full(len(sig), weight, np.int8)) for (sig, of), weight in found]
    return *(np.concatenate(x) for x in zip(*parts)), short


def _in_parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes, shingles) of some sets of (id, words) at a time, made of at most SHINGLES words or one set."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        values, offsets = _values(batch.column(1))
        at = 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHINGLES, side="right")) - 1)
            tokens, sizes = _distinct(values[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], width)
            yield ids[at:stop], sizes, tokens
            at = stop


def _emit(make: Callable, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, values in _in_parts(batches, width):
            sigs, of, *more = make(values, sizes)
            columns = sigs.view(np.int64), ids[of], sizes[of].astype(np.int32), *more
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "id", "n", "weight"][: len(columns)])

    return run


def _histogram(reps: DataFrame, width: int, cells: int) -> np.ndarray:
    """How many sets' shingles fall in each cell. Tasks count in arrays, which are added strip by strip: rows don't grow with the shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(cells, np.int64)
        for _, _, values in _in_parts(batches, width):
            out += np.bincount((values % np.uint64(cells)).astype(np.int64), minlength=cells)
        yield from packed(dict(enumerate(np.split(out, STRIPS))))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for strip, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[strip] = sums.get(strip, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        yield from packed(sums)

    def packed(strips: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for strip, counts in strips.items():
            data = zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([data], pa.binary())], names=["strip", "counts"])

    schema = "strip int, counts binary"
    rows = reps.select("id", "words").coalesce(COUNTING_TASKS).mapInArrow(count, schema).repartition("strip").mapInArrow(total, schema).collect()
    out = np.zeros((STRIPS, cells // STRIPS), np.int64)
    for row in rows:
        out[row["strip"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return out.reshape(cells)


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Parity bits of each set: two sets differ in at least as many shingles as in bits."""
    names = ["id", "n", *(f"f{w}" for w in range(PRINT_WORDS))]
    width = 64 * PRINT_WORDS
    for ids, sizes, values in _in_parts(batches, words):
        bits = (values >> np.uint64(32) & np.uint64(width - 1)).astype(np.int64) + np.repeat(np.arange(len(ids)), sizes) * width
        odd = (np.bincount(bits, minlength=len(ids) * width) & 1).astype(np.uint8).reshape(len(ids), width)
        prints = np.packbits(odd, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes.astype(np.int32)), *(pa.array(np.ascontiguousarray(prints[:, w])) for w in range(PRINT_WORDS))], names=names)


def _by_signatures(reps: DataFrame, width: int, limit: Threshold, free: float) -> DataFrame:
    """(a, b), a < b, materialized: every pair of sets within the limit, and others, by the universe partition."""
    spark = reps.sparkSession
    largest, shingles = (x or 0 for x in reps.agg(F.max("n"), F.sum("n")).first())
    bands = Bands(limit, largest, free)
    cells = spark.sparkContext.broadcast(_histogram(reps, width, CELLS))
    lacking = spark.sparkContext.accumulator(0)  # a task that runs again may count twice; only whether it is 0 matters

    def probing(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        *found, short = probe_signatures(tokens, sizes, bands, cells.value)
        lacking.add(int(short.sum()))
        return tuple(found)

    def short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, values in _in_parts(batches, width):
            short = probe_signatures(values, sizes, bands, cells.value)[3]
            yield pa.RecordBatch.from_arrays([pa.array(ids[short])], names=["id"])

    lists = reps.select("id", "words")
    index = lists.mapInArrow(_emit(lambda t, n: index_signatures(t, n, bands), width), _INDEX)
    probe = lists.mapInArrow(_emit(probing, width), _PROBE)
    close = F.col("ns") * limit.under >= F.col("nr") * limit.over
    turn = (F.col("nr") > F.col("ns")) | (F.col("nr") == F.col("ns")) & (F.col("r") < F.col("s"))  # the larger set probes
    # A pair has one row for each segment that matches: equal, or with one shingle more or less.
    matches = index.join(probe, "sig").filter(close & turn).groupBy("r", "s", "nr").agg(F.sum("weight").alias("weight"))
    enough = F.col("weight") > F.least(F.floor(F.col("nr") / SHARE), F.lit(SURPLUS))
    pairs = matches.filter(enough).select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b"))
    # There are about two signatures to a shingle; partitions of bounded size keep their sort small. Adaptive
    # execution still joins small partitions and splits those of frequent signatures.
    with initial_partitions(spark, shingles * 2 // SORTED_ROWS), hashed_joins(spark, HASHED_BYTES):
        pairs = materialize(pairs, "candidates")
    if lacking.value:
        few = materialize(lists.mapInArrow(short_sets, "id long"), "short-sets")
        sets = reps.select("id", "words").mapInArrow(_tokens(width), _TOKENS)
        one = sets.join(few, "id", "left_semi").select(F.col("id").alias("r"), F.col("n").alias("nr"), F.explode("tokens").alias("t"))
        all_ = sets.select(F.col("id").alias("s"), F.col("n").alias("ns"), F.explode("tokens").alias("t"))
        more = one.join(all_, "t").filter(close & (F.col("nr") >= F.col("ns")) & (F.col("r") != F.col("s")))
        pairs = materialize(pairs.unionAll(more.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b"))).distinct(), "candidates")
    cells.unpersist()
    return pairs


class Prefixes:
    """How much of a set, its rarest shingles first, has to be compared.

    Similar sets share at least ``overlap`` shingles. The first l of these lie among the first n - overlap + l of a set
    of n, whatever the order is, if all sets have the same. So sets that don't share l in such prefixes aren't similar.
    """

    def __init__(self, limit: Threshold):
        self.limit = limit

    def overlap(self, total):
        """Least number of shared shingles of two similar sets with ``total`` shingles together."""
        return -(-self.limit.over * total // (self.limit.under + self.limit.over))

    def smallest(self, n):
        return -(-self.limit.over * n // self.limit.under)

    def surplus(self, n):
        """l, by the size of the smaller set; not more than the overlap."""
        return 1 + np.minimum(n // SHARE, SURPLUS)

    def indexed(self, n):
        """The prefix that larger sets, or as large ones, are compared with."""
        return np.minimum(n, n - self.overlap(2 * n) + self.surplus(n))

    def probed(self, n):
        """The prefix that is compared with smaller sets, or as large ones."""
        return np.minimum(n, n - self.overlap(n + self.smallest(n)) + self.surplus(n))

    def largest(self, n, rank):
        """No set that is larger matches a shingle of this rank in a set of n."""
        return np.minimum(n, (n - rank + self.surplus(n) - 1) * (self.limit.under + self.limit.over) // self.limit.over - n)


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes first, then their second ones: the shuffle's compression takes out the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(data: memoryview, at: int, n: int, kind: type) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), at + n * size


def _pack(ids: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, of: np.ndarray, ranks: np.ndarray) -> bytes:
    """Rows of some sets: the sets by id, each once with its size, then (signature, number of the set, rank) by signature."""
    order = np.argsort(sigs, kind="stable")
    used, of = np.unique(of[order], return_inverse=True)  # the sets lie by id
    parts = np.diff(ids[used].view(np.uint64), prepend=np.uint64(0)), sizes[used].astype(np.uint32), np.diff(sigs[order], prepend=np.uint32(0)), of.astype(np.uint32), ranks[order].astype(np.uint16)
    return np.array([len(used), len(sigs)], np.int64).tobytes() + b"".join(map(_planes, parts))


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    sets, rows = np.frombuffer(data, np.int64, 2).tolist()
    out, at = [], 16
    for n, kind in ((sets, np.uint64), (sets, np.uint32), (rows, np.uint32), (rows, np.uint32), (rows, np.uint16)):
        x, at = _numbers(data, at, n, kind)
        out.append(x)
    ids, sizes, sigs, of, ranks = out
    return np.cumsum(ids, dtype=np.uint64).view(np.int64), sizes.astype(np.int64), np.cumsum(sigs, dtype=np.uint32), of.astype(np.int64), ranks.astype(np.int64)


def prefix_rows(tokens: np.ndarray, sizes: np.ndarray, prefixes: Prefixes, cells: np.ndarray, probing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of a shingle, number of the set, rank) of the prefixes; those that are only probed with, of sets that probe. A shingle alone in its cell is in one set and is left out."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    often = cells[(tokens % np.uint64(len(cells))).astype(np.int64)].astype(np.uint64)
    order = np.argsort(owner.astype(np.uint64) << np.uint64(32) | often, kind="stable")  # equally frequent ones stay as they are, sorted
    ranks = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = np.where(probing, prefixes.probed(sizes), prefixes.indexed(sizes))
    kept = (ranks < length[owner]) & (often[order] > 1)
    return mix(tokens[order][kept] + _C), owner[kept], ranks[kept]


def prefix_matches(ids: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, of: np.ndarray, ranks: np.ndarray, prefixes: Prefixes, probing: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(larger set, smaller set, shared shingles, how many they need) of the sets whose prefixes meet; a pair may come in parts."""
    order = np.argsort(sigs.astype(np.uint64) << np.uint64(32) | sizes[of].astype(np.uint64))
    sigs, of, ranks = sigs[order].astype(np.uint64) << np.uint64(32), of[order], ranks[order]
    n = sizes[of]
    index = np.flatnonzero(ranks < prefixes.indexed(n))
    keys = sigs[index] | n[index].astype(np.uint64)
    low, high = prefixes.smallest(n), prefixes.largest(n, ranks)
    probes = np.flatnonzero((low <= high) & probing[of])
    first = np.searchsorted(keys, sigs[probes] | low[probes].astype(np.uint64))
    many = np.searchsorted(keys, sigs[probes] | high[probes].astype(np.uint64), side="right") - first
    some = many > 0
    probes, first, many = probes[some], first[some], many[some]
    ends, at = np.cumsum(many), 0
    found: list[np.ndarray] = []
    width = np.int64(len(ids))

    def counted() -> tuple[np.ndarray, ...]:
        pairs, shared = np.unique(np.concatenate(found), return_counts=True)
        found.clear()
        r, s = pairs // width, pairs % width
        return r, s, shared, np.minimum(prefixes.surplus(sizes[s]), prefixes.overlap(sizes[r] + sizes[s]))

    while at < len(probes):
        done = ends[at] - many[at]
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRED, side="right")))
        for skip in range(0, int(many[at]) if stop == at + 1 else 1, PAIRED):  # a shingle of very many sets, too, is taken in parts
            each = np.minimum(many[at:stop] - skip, PAIRED) if stop == at + 1 else many[at:stop]
            p = np.repeat(probes[at:stop], each)
            q = index[np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[at:stop] + skip, each)]
            r, s = of[p], of[q]
            overlap = prefixes.overlap(n[p] + n[q])
            spare = np.minimum(prefixes.surplus(n[q]), overlap) - 1 - overlap
            ok = (ranks[p] <= n[p] + spare) & (ranks[q] <= n[q] + spare) & ((n[p] > n[q]) | (ids[r] < ids[s]))
            found.append(r[ok] * width + s[ok])
            if sum(map(len, found)) > PAIRED:
                yield counted()
        at = stop
    if found:
        yield counted()


def _by_prefixes(reps: DataFrame, width: int, limit: Threshold) -> DataFrame:
    """(a, b), a < b, materialized: every pair of sets within the limit, and others, by prefixes of the rarest shingles."""
    spark = reps.sparkSession
    shingles = reps.agg(F.sum("n")).first()[0] or 0
    prefixes = Prefixes(limit)
    cells = spark.sparkContext.broadcast(_histogram(reps, width, min(MOST_CELLS, max(FEWEST_CELLS, 1 << (shingles // 4).bit_length()))).astype(np.uint32))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // 2 // JOINED)

    def chosen(ids: np.ndarray, slices: range) -> np.ndarray:
        at = (mix(ids.view(np.uint64)) % np.uint64(SLICES)).astype(np.int64)
        return (at >= slices.start) & (at < slices.stop)

    def packing(slices: range, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            ids, sizes = (np.concatenate([x[i] for x in held]) for i in range(2))
            before = np.cumsum([0, *(len(x[0]) for x in held)])
            hashes, ranks = (np.concatenate([x[i] for x in held]) for i in (2, 4))
            of = np.concatenate([x[3] + at for x, at in zip(held, before.tolist())])
            held.clear()
            by_id = np.argsort(ids.view(np.uint64))
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            part = (hashes % np.uint64(partitions)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, of, ranks, sigs = part[order], place[of[order]], ranks[order], (hashes[order] >> np.uint64(32)).astype(np.uint32)
            ids, sizes = ids[by_id], sizes[by_id]
            starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(part)]):
                data = _pack(ids, sizes, sigs[a:b], of[a:b], ranks[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 1].astype(np.int32)), pa.array([data], pa.binary())], names=["part", "rows"])

        for ids, sizes, values in _in_parts(batches, width):
            hashes, of, ranks = prefix_rows(values, sizes, prefixes, cells.value, chosen(ids, slices))
            held.append((ids, sizes, hashes, of, np.minimum(ranks, 0xFFFF)))  # a lower rank only excludes less
            if sum(len(x[2]) for x in held) >= PACKED:
                yield from packed()
        if held:
            yield from packed()

    def joining(slices: range, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for _, blobs in groupby(rows, itemgetter(0)):
            blobs = [_unpack(data) for _, data in blobs]
            before = np.cumsum([0, *(len(x[0]) for x in blobs)]).tolist()
            of = np.concatenate([x[3] + at for x, at in zip(blobs, before)])
            ids, sizes, sigs, ranks = (np.concatenate([x[i] for x in blobs]) for i in (0, 1, 2, 4))
            for r, s, shared, need in prefix_matches(ids, sizes, sigs, of, ranks, prefixes, chosen(ids, slices)):
                made.add(len(r))
                columns = np.minimum(ids[r], ids[s]), np.maximum(ids[r], ids[s]), shared.astype(np.int32), need.astype(np.int32)
                for at in range(0, len(r), SHINGLES):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + SHINGLES]) for c in columns], names=["a", "b", "shared", "need"])

    made = spark.sparkContext.accumulator(0)  # steers how much a pass takes, nothing else

    def candidates(slices: range) -> DataFrame:
        rows = reps.select("id", "words").mapInArrow(partial(packing, slices), "part int, rows binary")
        meeting = rows.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(partial(joining, slices), "a long, b long, shared int, need int")
        enough = meeting.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).filter("shared >= need")
        return materialize(enough.select("a", "b"), "candidates")

    if shingles <= ONE_PASS:
        pairs = candidates(range(SLICES))
    else:
        done, each, pairs = 0, 1, None
        while done < SLICES:
            slices = range(done, min(SLICES, done + each))
            more = candidates(slices)
            pairs = more if pairs is None else pairs.unionAll(more)
            done = slices.stop
            each = max(1, int(PAIRS_EACH * shingles * done / max(1, made.value)))
    cells.unpersist()
    return pairs


_TOKENS = "id long, n int, tokens array<long>"


def _tokens(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, values in _in_parts(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes.astype(np.int32)), _listed(values, sizes)], names=["id", "n", "tokens"])

    return run


def _only(lists: DataFrame, ids: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The lists with these ids. The smaller of both tables, all ids or all others, is broadcast if it is proven small; else the lists are shuffled once and written."""
    if others is not None and fits_broadcast(others, BROADCAST_BYTES):
        return lists.join(F.broadcast(others), "id", "left_anti")
    if fits_broadcast(ids, BROADCAST_BYTES):
        return lists.join(F.broadcast(ids), "id", "left_semi")
    return materialize(lists.join(ids, "id", "left_semi"), "some-lists", **_PACKED_LISTS)


#: Words repeat: a dictionary large enough for a row group, and small row groups, keep them short.
_PACKED_LISTS = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20), "parquet.block.size": str(32 << 20)}


def _similar(lists: DataFrame, width: int, limit: Threshold, free: float | None = None) -> tuple[DataFrame, DataFrame]:
    """What :func:`similar_sets` returns, of lists of words as :func:`_word_lists` makes them."""
    # Each step is written, so its shuffle files are of no use when it ends: else those of all steps lie on disk together.
    with setting(lists.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        lists = materialize(lists, "word-lists", **_PACKED_LISTS)
        keys = lists.select("id", "h1", "h2", "n")
        members = keys.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")).join(keys, ["h1", "h2", "n"]).select("id", "rep")
        members = materialize(members, "set-members")
        reps = _only(lists, members.filter("id = rep").select("id"), members.filter("id <> rep").select("id")).select("id", "n", "words")
        pairs = _by_prefixes(reps, width, limit) if free is None else _by_signatures(reps, width, limit, free)
        prints = materialize(reps.select("id", "words").mapInArrow(partial(_fingerprints, words=width), "id long, n int, " + ", ".join(f"f{w} long" for w in range(PRINT_WORDS))), "fingerprints")
        left, right = (prints.toDF(x, f"n_{x}", *[f"{x}{i}" for i in range(PRINT_WORDS)]) for x in "ab")
        bits = reduce(add, (F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in range(PRINT_WORDS)))
        within = bits * (limit.under + limit.over) <= (F.col("n_a") + F.col("n_b")) * (limit.under - limit.over)
        likely = materialize(pairs.join(left, "a").join(right, "b").filter(within).select("a", "b", "n_a", "n_b"), "likely")
        ends = materialize(likely.select(F.col("a").alias("id")).unionAll(likely.select("b")).distinct(), "ends")
        tokens = _only(reps, ends).select("id", "words").mapInArrow(_tokens(width), _TOKENS)
        ta, tb = (tokens.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        checked = likely.join(ta, "a").join(tb, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
        links = checked.filter(F.col("common") * limit.under >= (F.col("n_a") + F.col("n_b") - F.col("common")) * limit.over)
        return members, materialize(links.select("a", "b", "common", "n_a", "n_b"), "links")


def similar_sets(sets: DataFrame, limit: Threshold, free: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links) of ``sets`` (id unique, n, tokens).

    members: (id, rep), every set and the least id among the equal ones; links: (a, b, common, n_a, n_b), the pairs
    of different representatives whose similarity is at least ``limit``, a < b. Candidates come from prefixes, or with
    ``free``, the expected segments for each one needed, from signatures; the result is the same.
    """
    return _similar(_token_lists(sets), 0, limit, free)


def near_duplicates(
    df: DataFrame, key: str, parts: list[str], width: int = 5, limit: Threshold = Threshold(4, 5), loaded: str | None = None, required: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records by the shingles of ``width`` words of their parts; see :func:`similar_sets`.

    A null part counts as empty; records whose ``required`` part is null or blank are left
    out. Records with a null key or fewer words than ``width`` have no shingles: they are
    neither members nor linked. A key that occurs again counts once, as
    :func:`lexiquarry.llm.canonical.once` says; other columns are ignored; an empty table
    gives no rows.
    """
    records = once(df, key, parts, loaded)
    if required:
        records = records.filter(visible(F.col(required)))
    return _similar(_word_lists(records, key, parts, width), width, limit)


def record_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(<key>_a, <key>_b), a < b: every pair of similar records, those of one class among them.

    ``members`` should be materialized, as :func:`similar_sets` leaves it. The result holds all
    pairs, as its size demands; it is joined by class, nothing is collected.
    """
    one, other = members.toDF("ka", "a"), members.toDF("kb", "b")
    between = links.select("a", "b").join(one, "a").join(other, "b").select("ka", "kb")
    within = one.join(members.toDF("kb", "a"), "a").filter("ka < kb").select("ka", "kb")
    pairs = between.unionByName(within)
    return pairs.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))


def record_links(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(<key>, class_id, n_links LONG): a row per record; its class of equal shingles, and to how many other classes it is linked."""
    ends = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias(key), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
