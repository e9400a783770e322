"""Index documents as they arrive: each micro-batch becomes a segment, and all segments are searched as one index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexiquarry.operators.index import Index
from lexiquarry.workspace import names_in


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files that arrive at ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def index_stream(documents: DataFrame, path: str, checkpoint: str, stemmer: str = "none", kgram: bool = True, available_now: bool = False) -> StreamingQuery:
    """Index a stream of documents (doc_id, body, ...). A batch that is repeated after a failure replaces its own segment.

    A doc_id must arrive once. Empty batches leave no segment.
    """

    def segment(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Index.build(batch, f"{path.rstrip('/')}/segment={number}", stemmer, kgram)

    writer = documents.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class SegmentedIndex(Index):
    """All segments below a path. Documents lie in one segment each, so only vocabularies and corpus statistics are merged."""

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SegmentedIndex:
        where = [f"{path.rstrip('/')}/{name}" for name in names_in(spark, path) if name.startswith("segment=") and names_in(spark, f"{path.rstrip('/')}/{name}/builds")]
        each = {at: cls.settings_at(spark, at) for at in where}
        if not each:
            raise FileNotFoundError(f"no segments at {path}")
        sizes = [(s["n_docs"], s["avg_doc_length"] or 0.0) for s in each.values()]
        n = sum(a for a, _ in sizes)
        settings = {
            "stemmer": next(iter(each.values()))["stemmer"], "kgram": all(s["kgram"] for s in each.values()),
            "n_docs": n, "avg_doc_length": sum(a * b for a, b in sizes) / n if n else None, "folders": [f"{at}/build={s['build']}" for at, s in each.items()],
        }
        return cls(spark, path, settings)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{folder}/{name}" for folder in self.settings["folders"]])

    @property
    def vocab(self) -> DataFrame:
        return self._table("vocab").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    @property
    def norms(self) -> DataFrame:
        return super().norms if self.stemmer == "none" else self._table("norms").distinct()

    @property
    def kgrams(self) -> DataFrame:
        return super().kgrams.distinct()
