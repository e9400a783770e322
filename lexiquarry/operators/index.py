"""The index: documents with their terms, postings with positions and weights, vocabulary, k-grams.

All tables are DataFrames; an :class:`Index` reads them from Parquet. ``forward`` has a row
per document: its statistics and its terms. Postings are range partitioned and sorted by
(term, doc_id): a term's rows lie together, so a lookup prunes row groups by their
statistics, and a term in most documents spans as many files as it needs. They carry what
ranking and classification ask of a document, so neither joins the documents before the
few rows that come out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry import workspace
from lexiquarry.functions.analysis import STEMMERS, emitted_terms
from lexiquarry.functions.porter2 import stem_all, stem_column

GRAM_SIZES = (1, 2, 3)
#: Bytes a core below which a table's texts are spread before they are indexed.
SPREAD_BYTES = 16 << 20


def normalized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, body, file_name, byte_size, class) of documents that may lack the last three; other columns are left out."""
    has = set(documents.columns)
    optional = {
        "file_name": F.concat(F.lit("doc"), F.col("doc_id").cast("string")),
        "byte_size": F.coalesce(F.octet_length("body"), F.lit(0)).cast("long"),
        "class": F.lit(None).cast("string"),
    }
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "body", *[(F.col(c) if c in has else e).alias(c) for c, e in optional.items()])


_FORWARD = (
    "doc_id long, file_name string, class string, byte_size long, l_d double, doc_length long, emitted long, "
    "terms array<string>, tf_emit array<int>, positions array<array<int>>, norms array<string>"
)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _count_terms(stemmer: str):
    """Group the emitted terms of each document of a batch, all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            emitted = batch.column(4)
            spelt, at = emitted.flatten().flatten()
            per_doc = pc.list_value_length(emitted).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(n), per_doc)
            encoded = spelt.dictionary_encode()
            words, code, at = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False), at.to_numpy(zero_copy_only=False)
            norms = _lists(np.zeros(n, np.int64), pa.array([], pa.string()))
            if stemmer != "none":
                own = np.unique(doc << 32 | code)
                norms = _lists(np.bincount(own >> 32, minlength=n), words.take(pa.array(own & 0xFFFFFFFF)))
                stems = pa.array(stem_all(words.to_pylist()), pa.string()).dictionary_encode()
                words, code = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False)[code]
            key = doc << 32 | code
            order = np.argsort(key, kind="stable")  # positions stay in order
            key, at = key[order], at[order]
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            tf_emit = np.diff(np.append(starts, len(key)))
            apart = new.copy()
            apart[1:] |= at[1:] != at[:-1]
            tf = np.add.reduceat(apart.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
            owner = key[starts] >> 32
            length = np.bincount(owner, minlength=n)
            norm = np.sqrt(np.bincount(owner, weights=(1 + np.log(tf_emit)) ** 2, minlength=n))
            columns = [
                *batch.columns[:4], pa.array(norm), pa.array(length), pa.array(per_doc),
                _lists(length, words.take(pa.array(key[starts] & 0xFFFFFFFF))), _lists(length, pa.array(tf_emit.astype(np.int32))),
                _lists(length, _lists(tf, pa.array(at[apart].astype(np.int32)))), norms,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FORWARD.split(", ")])

    return run


def forward_table(docs: DataFrame, stemmer: str = "none") -> DataFrame:
    """A row per document: statistics, distinct terms with emissions and positions, and the unstemmed terms if there is a stemmer.

    doc_id is unique, so each document's tokens lie in one task: nothing is shuffled. The
    text is taken apart by built-in expressions and counted batch by batch. l_d is the norm
    of the default weights, doc_length the number of distinct terms.
    """
    if stemmer not in STEMMERS:
        raise ValueError(f"stemmer must be one of {STEMMERS}")
    return docs.select("doc_id", "file_name", "class", "byte_size", emitted_terms(F.col("body")).alias("emitted")).mapInArrow(_count_terms(stemmer), _FORWARD)


def stats_of(forward: DataFrame) -> DataFrame:
    """One row per document, also for those without terms: l_d 0, doc_length 0, avg_tftd null."""
    return forward.select("doc_id", "file_name", "class", "l_d", "doc_length", "byte_size", _avg_tftd())


def _avg_tftd() -> Column:
    return F.when(F.col("doc_length") > 0, F.col("emitted") / F.col("doc_length")).alias("avg_tftd")


def postings_table(forward: DataFrame) -> DataFrame:
    """(term, doc_id, tf_emit, tf, positions, stored weights, and of the document class, l_d, doc_length, byte_size, avg_tftd)."""
    rows = forward.select("doc_id", "class", "l_d", "doc_length", "byte_size", _avg_tftd(), F.inline(F.arrays_zip("terms", "tf_emit", "positions")))
    weight = 1 + F.log("tf_emit")
    return rows.select(
        F.col("terms").alias("term"), "doc_id", "tf_emit", F.size("positions").alias("tf"), "positions", weight.alias("w_default"),
        F.log(F.col("doc_length") / F.col("tf_emit")).alias("w_tfidf"), (F.lit(2.2) * F.col("tf_emit")).alias("w_okapi"),
        (weight / (1 + F.log("avg_tftd"))).alias("w_wacky"), "class", "l_d", "doc_length", "byte_size", "avg_tftd",
    )


def norms_table(forward: DataFrame) -> DataFrame:
    """(norm, term): unstemmed terms and what they become; only distinct ones are stemmed."""
    return forward.select(F.explode("norms").alias("norm")).distinct().select("norm", stem_column("norm").alias("term"))


def grams(norm: Column) -> Column:
    """ARRAY<STRING>: all 1-, 2- and 3-grams of a term between ``$`` signs."""
    padded = F.concat(F.lit("$"), norm, F.lit("$"))
    n = F.length(padded)

    def of_size(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(padded, i, F.lit(k)))

    return F.array_distinct(F.concat(*map(of_size, GRAM_SIZES)))


def kgram_table(norms: DataFrame) -> DataFrame:
    """(gram, term) of the ASCII terms of the vocabulary, unstemmed; ``norms`` has each once."""
    ascii_only = norms.filter(F.col("norm").rlike(r"^[\x00-\x7F]+$"))
    return ascii_only.select(F.explode(grams(F.col("norm"))).alias("gram"), F.col("norm").alias("term"))


def vocab_table(postings: DataFrame) -> DataFrame:
    """(term, df LONG, cf LONG); counts are combined before the shuffle."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_table(doc_stats: DataFrame) -> DataFrame:
    """One row: n_docs, avg_doc_length (null for no documents)."""
    return doc_stats.agg(F.count("*").alias("n_docs"), F.avg("doc_length").alias("avg_doc_length"))


class NoGrams(ValueError):
    """The index was built without k-grams."""


class Index:
    """An index stored below a path.

    Each build lies in a folder of its own; the highest numbered file in ``builds`` says
    which one is in force, with the settings and the statistics of the collection.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.stemmer: str = settings["stemmer"]

    @classmethod
    def build(cls, documents: DataFrame, path: str, stemmer: str = "none", kgram: bool = True, store: bool = False) -> Index:
        """Build all tables of documents (doc_id, body and optionally file_name, byte_size, class) and replace what lies at ``path``.

        doc_id must be unique and not null. A document without terms counts in n_docs. A
        build that dies leaves the index as it was. The text is read once; what is shuffled
        are the postings, when they are sorted, and what follows from the vocabulary. With
        ``store`` the documents are kept with all their columns (:meth:`stored`) and indexed
        as kept, so both agree whatever becomes of their source.
        """
        spark, path = documents.sparkSession, path.rstrip("/")
        settings = {"build": uuid.uuid4().hex[:12], "stemmer": stemmer, "kgram": kgram}
        self = cls(spark, path, settings)
        if store:
            documents.write.option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{self._folder}/documents")
            documents = self.stored
        docs = normalized_documents(documents)
        cores = spark.sparkContext.defaultParallelism
        size = workspace.size_of(documents)
        if size is not None and size < cores * SPREAD_BYTES:  # a small table lies in few files: its texts are spread over the cores
            docs = docs.repartition(cores)
        writer = forward_table(docs, stemmer).write.option("parquet.bloom.filter.enabled#doc_id", "true")
        writer.parquet(f"{self._folder}/forward")
        self._write("postings", postings_table(self.forward), "term", "doc_id")
        self._write("vocab", vocab_table(self.postings), "term")
        if stemmer != "none":
            self._write("norms", norms_table(self.forward), "norm")
        if kgram:
            self._write("kgrams", kgram_table(self.norms), "gram", "term")
        settings |= corpus_table(self.doc_stats).first().asDict()
        builds = cls._builds(spark, path)
        workspace.write_new(spark, f"{path}/builds/{max(builds, default=0) + 1:09d}.json", json.dumps(settings))
        for old in builds:  # what was in force before, and what died on the way
            workspace.drop(spark, f"{path}/builds/{old:09d}.json")
        for name in workspace.names_in(spark, path):
            if name.startswith("build=") and name != f"build={settings['build']}":
                workspace.drop(spark, f"{path}/{name}")
        return self

    @staticmethod
    def _builds(spark: SparkSession, path: str) -> list[int]:
        return [int(name[:-5]) for name in workspace.names_in(spark, f"{path}/builds") if name[:-5].isdigit() and name.endswith(".json")]

    def _write(self, name: str, table: DataFrame, *order: str) -> None:
        """A table sorted over all its files."""
        table.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self._folder}/{name}")

    @classmethod
    def settings_at(cls, spark: SparkSession, path: str) -> dict:
        builds = cls._builds(spark, path.rstrip("/"))
        if not builds:
            raise FileNotFoundError(f"no index at {path}")
        return json.loads(workspace.read_text(spark, f"{path.rstrip('/')}/builds/{max(builds):09d}.json"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark, path, cls.settings_at(spark, path))

    @property
    def _folder(self) -> str:
        return f"{self.path}/build={self.settings['build']}"

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}")

    forward = property(lambda self: self._table("forward"))
    doc_stats = property(lambda self: stats_of(self.forward))
    postings = property(lambda self: self._table("postings"))
    vocab = property(lambda self: self._table("vocab"))
    stored = property(lambda self: self._table("documents"))

    @property
    def norms(self) -> DataFrame:
        """(norm, term) of the vocabulary."""
        return self.vocab.select(F.col("term").alias("norm"), "term") if self.stemmer == "none" else self._table("norms")

    @property
    def has_kgrams(self) -> bool:
        return self.settings["kgram"]

    @property
    def kgrams(self) -> DataFrame:
        """(gram, term); :class:`NoGrams` if the index was built without."""
        if not self.has_kgrams:
            raise NoGrams(f"the index at {self.path} was built without k-grams")
        return self._table("kgrams")

    def kgram_status(self) -> DataFrame:
        """One row (enabled BOOLEAN, grams LONG): whether the index has k-grams, and how many different ones."""
        if not self.has_kgrams:
            return self.spark.createDataFrame([(False, 0)], "enabled boolean, grams long")
        return self.kgrams.agg(F.lit(True).alias("enabled"), F.countDistinct("gram").alias("grams"))

    @property
    def corpus_stats(self) -> DataFrame:
        row = (self.settings["n_docs"], self.settings["avg_doc_length"])
        return self.spark.createDataFrame([row], "n_docs long, avg_doc_length double")

    # Lookups

    def n_docs(self) -> int:
        return self.settings["n_docs"]

    def postings_of(self, term: str, positions: bool = True) -> DataFrame:
        """Postings of a term, none if it is absent; without positions their column isn't read."""
        found = self.postings.filter(F.col("term") == term)
        return found if positions else found.drop("positions")

    def document_weights(self, doc_id: int) -> DataFrame:
        """(avg_doc_length, l_d, doc_length, byte_size, avg_tftd) of a document; files without it are left out by their Bloom filters."""
        stats = self.doc_stats.filter(F.col("doc_id") == doc_id)
        return stats.select(F.lit(self.settings["avg_doc_length"]).alias("avg_doc_length"), "l_d", "doc_length", "byte_size", "avg_tftd")

    def document_frequency(self, term: str) -> int:
        row = self.vocab.filter(F.col("term") == term).first()
        return row["df"] if row else 0

    def collection_frequency(self, term: str) -> int:
        row = self.vocab.filter(F.col("term") == term).first()
        return row["cf"] if row else 0

    def total_term_frequency(self) -> int:
        return self.vocab.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]

    def terms_of(self, doc_id: int) -> DataFrame:
        return self.forward.filter(F.col("doc_id") == doc_id).select(F.explode("terms").alias("term"))

    def contains(self, term: str) -> bool:
        return not self.vocab.filter(F.col("term") == term).isEmpty()

    def vocabulary(self, limit: int | None = 30) -> DataFrame:
        ordered = self.vocab.select("term").orderBy("term")
        return ordered.limit(limit) if limit is not None else ordered

    def vocabulary_size(self) -> int:
        return self.vocab.count()

    def gram_list(self) -> DataFrame:
        return self.kgrams.select("gram").distinct().orderBy("gram")

    def terms_of_gram(self, gram: str) -> DataFrame:
        """Terms that hold the gram; none if it is unknown."""
        return self.kgrams.filter(F.col("gram") == gram).select("term")

    def inverted(self) -> DataFrame:
        """The plain index: (term, doc_id), ascending within a term's file."""
        return self.postings.select("term", "doc_id")
