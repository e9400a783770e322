"""The engine as one object: build or open an index, search, look at vocabularies, classify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions.analysis import normalize
from lexiquarry.functions.porter2 import stem
from lexiquarry.operators import retrieval
from lexiquarry.operators.classify import Classifier
from lexiquarry.operators.index import Index
from lexiquarry.sources.collections import read_directory


class Engine:
    CLASSIFIERS = ("bayesian", "rocchio")

    def __init__(self, index: Index):
        self.index = index
        self.spark = index.spark

    # Build and open

    @classmethod
    def build(cls, documents: DataFrame, path: str, stemmer: str = "english", kgram: bool = True) -> Engine:
        """Index documents (doc_id, body and optionally file_name, title, url, byte_size, class), replacing what lies at ``path``."""
        return cls(Index.build(documents, path, stemmer, kgram, store=True))

    @classmethod
    def build_directory(cls, spark: SparkSession, directory: str, path: str, stemmer: str = "english", kgram: bool = True) -> Engine:
        return cls.build(read_directory(spark, directory), path, stemmer, kgram)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Engine:
        return cls(Index.open(spark, path))

    # Search

    def search(self, query: str, mode: str = "boolean", scheme: str = "default", k: int | None = 10) -> DataFrame:
        if mode == "boolean":
            return self.search_boolean(query)
        if mode == "ranked":
            return self.search_ranked(query, scheme, k)
        raise ValueError("mode must be boolean or ranked")

    def search_boolean(self, query: str) -> DataFrame:
        return retrieval.search_boolean(self.index, query)

    def search_ranked(self, query: str, scheme: str = "default", k: int | None = 10, kgram: bool = True, textbook: bool = False, counted: bool = False) -> DataFrame:
        return retrieval.search_ranked(self.index, query, scheme, k, kgram, textbook, counted)

    def search_batch(self, queries: DataFrame, text: str = "text", scheme: str = "default", k: int = 10) -> DataFrame:
        """Rank many queries (query_id, <text>) in one job."""
        return retrieval.rank(self.index, retrieval.batch_terms(self.index, queries, text), scheme, k)

    def open_document(self, file_name: str) -> DataFrame:
        """Title, body and url of the documents of that name."""
        stored = self.index.stored
        names = self.index.forward.filter(F.col("file_name") == file_name).select("doc_id")
        return stored.join(names, "doc_id", "left_semi").select(*[c for c in ("title", "body", "url") if c in stored.columns])

    # Terms

    @staticmethod
    def analyze(token: str) -> dict[str, list[str]]:
        """What a token becomes before and after stemming."""
        found = normalize(token)
        return {"normalized": found, "stemmed": [stem(t) for t in found]}

    def vocabulary(self, limit: int | None = 30) -> DataFrame:
        return self.index.vocabulary(limit)

    def vocabulary_size(self) -> int:
        return self.index.vocabulary_size()

    def kgram_status(self) -> DataFrame:
        return self.index.kgram_status()

    def kgrams(self) -> DataFrame:
        return self.index.gram_list()

    # Classes

    def classify(self, classifier: str = "bayesian", file_name: str | None = None, k: int = 50) -> DataFrame:
        """(doc_id, file_name, class) of all documents without a class, or of those of one name."""
        if classifier not in self.CLASSIFIERS:
            raise ValueError(f"classifier must be one of {self.CLASSIFIERS}")
        own = Classifier(self.index)
        return own.classify_bayes(k, file_name=file_name) if classifier == "bayesian" else own.classify_rocchio(file_name=file_name)

    def discriminating_terms(self, k: int = 50) -> DataFrame:
        return Classifier(self.index).discriminating_terms(k)

    def centroids(self, limit: int | None = 30) -> DataFrame:
        return Classifier(self.index).centroids(limit)

    def all_vocabulary(self, include_unlabelled: bool = False) -> DataFrame:
        return Classifier(self.index).all_vocabulary(include_unlabelled)
