"""Mutual information, naive Bayes and nearest centroid over classes of documents.

Documents with a class train, those without are classified. The postings hold the class
and the norm of their document, so training is one grouping by term, with the counts and
centroids of all classes side by side: a row per term, written once and read by all
methods. Classes are few (each is a set of columns); what is per class fits the driver.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.operators.index import Index
from lexiquarry.workspace import fits_broadcast, materialize

#: The table of terms up to this many bytes, proven by a count, is broadcast to the documents' terms; beyond it both are shuffled.
BROADCAST_BYTES = 32 << 20


class Classifier:
    """Classifiers on an index whose documents have a ``class`` (null: to be classified)."""

    def __init__(self, index: Index):
        self.index = index

    # Parts

    def class_sizes(self) -> DataFrame:
        """(class, n_c)."""
        return self.index.forward.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("n_c"))

    @cached_property
    def sizes(self) -> list[tuple[str, int]]:
        """The classes in order, and their numbers of documents."""
        return sorted((r["class"], r["n_c"]) for r in self.class_sizes().collect())

    @cached_property
    def wide(self) -> DataFrame:
        """(term, and for class i: df<i>, cf<i>, sum<i> of the components): a row per term of the labelled documents, materialized."""
        postings = self.index.postings.filter("class IS NOT NULL")
        component = F.col("w_default") / F.col("l_d")
        sums: list[Column] = []
        for i, (name, _) in enumerate(self.sizes):
            own = F.col("class") == name
            sums += [F.count(F.when(own, 1)).alias(f"df{i}"), F.coalesce(F.sum(F.when(own, F.col("tf"))), F.lit(0)).alias(f"cf{i}"), F.coalesce(F.sum(F.when(own, component)), F.lit(0.0)).alias(f"sum{i}")]
        return materialize(postings.groupBy("term").agg(*(sums or [F.lit(0).alias("none")])), "class-terms")

    def _by_class(self, *values: tuple[str, list[Column]]) -> Column:
        """Rows (class, values...) out of columns of all classes."""
        return F.inline(F.array(*[F.struct(F.lit(name).alias("class"), *[columns[i].alias(v) for v, columns in values]) for i, (name, _) in enumerate(self.sizes)]))

    def class_terms(self) -> DataFrame:
        """(class, term, df, cf): of each term in each class that holds it."""
        if not self.sizes:
            return self.index.spark.createDataFrame([], "class string, term string, df long, cf long")
        each = range(len(self.sizes))
        rows = self.wide.select("term", self._by_class(("df", [F.col(f"df{i}") for i in each]), ("cf", [F.col(f"cf{i}") for i in each])))
        return rows.filter("df > 0").select("class", "term", "df", "cf")

    def all_vocabulary(self, include_unlabelled: bool = False) -> DataFrame:
        """(term): the sorted union of the classes' vocabularies."""
        return (self.index.vocab if include_unlabelled else self.wide).select("term").orderBy("term")

    def _unlabelled(self, file_name: str | None) -> tuple[DataFrame, DataFrame]:
        """(documents, terms): doc_id and file_name of those to be classified, and their (doc_id, term, component); of one file from the documents' rows alone."""
        docs = self.index.forward.filter("class IS NULL")
        if file_name is None:
            terms = self.index.postings.filter("class IS NULL").select("doc_id", "term", (F.col("w_default") / F.col("l_d")).alias("component"))
        else:
            docs = docs.filter(F.col("file_name") == file_name)
            held = docs.select("doc_id", "l_d", F.inline(F.arrays_zip("terms", "tf_emit")))
            terms = held.select("doc_id", F.col("terms").alias("term"), ((1 + F.log("tf_emit")) / F.col("l_d")).alias("component"))
        return docs.select("doc_id", "file_name"), terms

    # Mutual information

    def contingency(self) -> DataFrame:
        """(class, term, n11, n10, n01, n00): documents in or out of the class (first) with or without the term (second)."""
        if not self.sizes:
            return self.index.spark.createDataFrame([], "class string, term string, n11 long, n10 long, n01 long, n00 long")
        total = sum(n for _, n in self.sizes)
        inside = [F.col(f"df{i}") for i in range(len(self.sizes))]
        held = sum(inside, F.lit(0))
        cells = self._by_class(
            ("n11", inside), ("n10", [F.lit(n) - x for x, (_, n) in zip(inside, self.sizes)]), ("n01", [held - x for x in inside]), ("n00", [F.lit(total - n) - held + x for x, (_, n) in zip(inside, self.sizes)])
        )
        return self.wide.select("term", cells).filter("n11 > 0").select("class", "term", *[F.col(c).cast("long").alias(c) for c in ("n11", "n10", "n01", "n00")])

    def mutual_information(self) -> DataFrame:
        """(class, term, score): in bits; an empty cell of the table adds nothing."""
        cells = {(i, j): F.col(f"n{i}{j}").cast("double") for i in (0, 1) for j in (0, 1)}
        n = sum(cells.values(), F.lit(0.0))
        score = F.lit(0.0)
        for (i, j), cell in cells.items():
            margins = (cells[i, 0] + cells[i, 1]) * (cells[0, j] + cells[1, j])
            score = score + F.when(cell > 0, cell / n * F.log2(n * cell / margins)).otherwise(0.0)
        return self.contingency().select("class", "term", score.alias("score"))

    def discriminating_terms(self, k: int = 50, decimals: int = 9) -> DataFrame:
        """(rank, term, class, score): the k best terms, each under its best class; of equals the first class and term."""
        rounded = self.mutual_information().withColumn("score", F.round("score", decimals))
        best = Window.partitionBy("term").orderBy(F.desc("score"), "class")
        top = rounded.withColumn("_r", F.row_number().over(best)).filter("_r = 1").orderBy(F.desc("score"), "term").limit(k)
        return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "term")).alias("rank"), "term", "class", "score")

    # Naive Bayes

    def bayes_scores(self, k: int = 50, file_name: str | None = None) -> DataFrame:
        """(doc_id, class, score): log2 of prior times smoothed likelihoods of the document's distinct discriminating terms.

        The k terms and the classes bound the tables that are broadcast. Documents without any of the terms get the prior.
        """
        docs, held = self._unlabelled(file_name)
        if not self.sizes:
            return docs.limit(0).select("doc_id", F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("score"))
        terms = [r["term"] for r in self.discriminating_terms(k).collect()]  # at most k
        counts = {r["term"]: r for r in self.wide.filter(F.col("term").isin(terms)).collect()}
        each, total = range(len(self.sizes)), sum(n for _, n in self.sizes)
        sums = [sum(counts[t][f"cf{i}"] for t in terms) + len(terms) for i in each]
        likelihoods = self.index.spark.createDataFrame(
            [(t, *[math.log2((counts[t][f"cf{i}"] + 1) / sums[i]) for i in each]) for t in terms], "term string, " + ", ".join(f"l{i} double" for i in each)
        )
        found = held.filter(F.col("term").isin(terms)).select("doc_id", "term").join(F.broadcast(likelihoods), "term")
        part = found.groupBy("doc_id").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in each])
        score = [F.lit(math.log2(n / total)) + F.coalesce(F.col(f"l{i}"), F.lit(0.0)) for i, (_, n) in enumerate(self.sizes)]
        return docs.select("doc_id").join(part, "doc_id", "left").select("doc_id", self._by_class(("score", score)))

    def classify_bayes(self, k: int = 50, decimals: int = 6, file_name: str | None = None) -> DataFrame:
        """(doc_id, file_name, class): the best class, of equals the first in order; of all unlabelled documents or those of one name."""
        return self._pick(self.bayes_scores(k, file_name).withColumn("_by", -F.round("score", decimals)), file_name)

    # Nearest centroid

    def centroids(self, limit: int | None = None) -> DataFrame:
        """(class, term, component): means of the classes' vectors, whose components are w_default over the document's norm; with a limit the first terms of each class."""
        if not self.sizes:
            return self.index.spark.createDataFrame([], "class string, term string, component double")
        each = range(len(self.sizes))
        means = ("component", [F.col(f"sum{i}") / F.lit(float(self.sizes[i][1])) for i in each])
        mean = self.wide.select("term", self._by_class(means, ("_df", [F.col(f"df{i}") for i in each]))).filter("_df > 0").select("class", "term", "component")
        if limit is None:
            return mean
        order = Window.partitionBy("class").orderBy("term")
        return mean.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")

    def distances(self, file_name: str | None = None) -> DataFrame:
        """(doc_id, class, distance) of unlabelled documents to the centroids, over the terms of labelled documents.

        sqrt(|d|^2 + |c|^2 - 2 d.c): only terms that both hold are joined. The centroids of
        all classes lie side by side, so documents' terms meet one row per term, in a
        broadcast if the table is proven small.
        """
        docs, held = self._unlabelled(file_name)
        if not self.sizes:
            return docs.limit(0).select("doc_id", F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("distance"))
        each = range(len(self.sizes))
        centroids = self.wide.select("term", *[(F.col(f"sum{i}") / F.lit(float(n))).alias(f"c{i}") for i, (_, n) in enumerate(self.sizes)])
        norms = centroids.agg(*[F.coalesce(F.sum(F.pow(f"c{i}", F.lit(2))), F.lit(0.0)).alias(f"n{i}") for i in each]).first()
        joined = held.join(F.broadcast(centroids) if fits_broadcast(centroids, BROADCAST_BYTES) else centroids, "term")
        dots = joined.groupBy("doc_id").agg(F.sum(F.pow("component", F.lit(2))).alias("_n"), *[F.sum(F.col("component") * F.col(f"c{i}")).alias(f"_d{i}") for i in each])
        full = docs.select("doc_id").join(dots, "doc_id", "left").fillna(0.0)
        distance = [F.sqrt(F.greatest(F.lit(0.0), F.col("_n") + F.lit(float(norms[f"n{i}"])) - 2 * F.col(f"_d{i}"))) for i in each]
        return full.select("doc_id", self._by_class(("distance", distance)))

    def classify_rocchio(self, decimals: int = 9, file_name: str | None = None) -> DataFrame:
        """(doc_id, file_name, class): the class of the nearest centroid, of equals the first in order; of all unlabelled documents or those of one name."""
        return self._pick(self.distances(file_name).withColumn("_by", F.round("distance", decimals)), file_name)

    def _pick(self, scored: DataFrame, file_name: str | None) -> DataFrame:
        best = scored.groupBy("doc_id").agg(F.min(F.struct("_by", "class")).alias("_best"))
        return best.join(self._unlabelled(file_name)[0], "doc_id").select("doc_id", "file_name", F.col("_best")["class"].alias("class"))
