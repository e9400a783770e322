"""Problem 5: frequency of every term, kept up to date by signed deltas.

A store holds, below one path of a shared file system, three tables whose rows are signed:
what a key comes to is the sum over its rows.

* ``records``: (doc_id, term, tf, n), the terms of every record, in buckets of the record id,
* ``prints``: (doc_id, fingerprint, n), a fingerprint of each record's terms, in the same buckets,
* ``counts``: (term, occurrences, records), in buckets of the term.

Only records that were added, changed or deleted since are aggregated: their new rows
count +1, their old rows -1, and the sums per term are the change's delta. A change writes
its deltas as new segments of the buckets they fall in; a bucket of more than ``SEGMENTS``
segments is merged into one. So a small change writes little, and a bucket is written anew
once in several changes.

Each attempt at a change writes under names of its own, and a numbered manifest, which
appears at once by renaming, says which segments hold each bucket; the highest one that can
be read is in force. A change that dies at any point leaves the store as it was and can be
tried again; of two changes at a time one fails. What no manifest names is removed by
:meth:`TermCounts.vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry import workspace

_SCHEMA = {
    "records": "doc_id long, term string, tf long, n long",
    "prints": "doc_id long, fingerprint long, n long",
    "counts": "term string, occurrences long, records long",
}
_KEY = {"records": "doc_id", "prints": "doc_id", "counts": "term"}

#: Segments of a bucket before it is merged.
SEGMENTS = 8
#: Rows of the first load for each bucket, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 4_000_000, 8


def _net(table: str, rows: DataFrame) -> DataFrame:
    """The sum over the signed rows of each key; keys that came to nothing have no row."""
    if table == "counts":
        return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).filter("records <> 0 OR occurrences <> 0")
    if table == "prints":  # a fingerprint that is added twice is gone
        return rows.groupBy("doc_id").agg(F.bit_xor("fingerprint").alias("fingerprint"), F.sum("n").alias("n")).filter("n <> 0")
    return rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.sum("n").alias("n")).filter("n <> 0")


class TermCounts:
    """Counts of terms over a changing collection. ``buckets`` is fixed by the first change, by its size unless given."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        self.manifest = self._newest() or {"change": 0, "buckets": buckets or BUCKETS, "records": {}, "prints": {}, "counts": {}}

    def _newest(self) -> dict | None:
        for number in sorted(self._manifests(), reverse=True):
            try:
                return json.loads(workspace.read_text(self.spark, self._manifest_path(number)) or "")
            except ValueError:  # a half-written one of a file system without whole renames
                continue
        return None

    def _manifests(self) -> list[int]:
        names = workspace.names_in(self.spark, f"{self.path}/manifests")
        return [int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit()]

    def _manifest_path(self, number: int) -> str:
        return f"{self.path}/manifests/{number:012d}.json"

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest["buckets"])).cast("int")

    def _read(self, table: str, only: list[int] | None = None, of: dict | None = None) -> DataFrame:
        """The net rows of a table, or of some of its buckets."""
        held = {b: segments for b, segments in (of or self.manifest)[table].items() if only is None or int(b) in only}
        if not held:
            return self.spark.createDataFrame([], _SCHEMA[table])
        rows = self.spark.read.schema(_SCHEMA[table]).parquet(*[f"{self.path}/{table}/segment={s}/bucket={b}" for b, segments in sorted(held.items()) for s in segments])
        return rows if all(len(segments) == 1 for segments in held.values()) else _net(table, rows)

    def _write(self, table: str, rows: DataFrame) -> dict[str, str]:
        """Write rows as a segment of the buckets that they fall in: bucket to segment. Buckets are brought together, so files are few."""
        segment = uuid.uuid4().hex[:16]
        where = f"{self.path}/{table}/segment={segment}"
        rows.withColumn("bucket", self._bucket(_KEY[table])).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(where)
        return {name.partition("=")[2]: segment for name in workspace.names_in(self.spark, where) if name.startswith("bucket=")}

    def counts(self) -> DataFrame:
        """(term, occurrences LONG, records LONG) of the collection as it is now; terms that no record holds have no row."""
        return self._read("counts")

    def n_records(self) -> int:
        return self._read("prints").count()

    def apply(self, now: DataFrame, whole: bool = True, deleted: DataFrame | None = None) -> dict[str, int]:
        """Take in ``now``: clean (term, doc_id, tf) rows of all records, or with ``whole=False`` of those that may have changed.

        Records missing from a whole ``now`` are deleted; else those in ``deleted`` (doc_id) are.
        Records without terms aren't part of the collection. ``now`` should be materialized.
        Returns how many records were added, changed and deleted.
        """
        with workspace.scope(self.spark):
            return self._apply(now, whole, deleted)

    def _apply(self, now: DataFrame, whole: bool, deleted: DataFrame | None) -> dict[str, int]:
        first = not self.manifest["prints"]
        if first and not self._buckets:
            self.manifest["buckets"] = max(BUCKETS, now.count() // BUCKET_ROWS)
        new = now.groupBy("doc_id").agg(F.bit_xor(F.xxhash64("term", "tf")).alias("_new"))
        if first:
            changes = new.select("doc_id", F.lit(None).cast("long").alias("_old"), "_new")
        else:
            old = self._read("prints").select("doc_id", F.col("fingerprint").alias("_old"))
            changes = new.join(old, "doc_id", "full" if whole else "left").select("doc_id", "_old", "_new")
            if deleted is not None:
                gone = deleted.select("doc_id").dropna().distinct().join(new, "doc_id", "left_anti").join(old, "doc_id")
                changes = changes.unionAll(gone.select("doc_id", "_old", F.lit(None).cast("long")))
            changes = changes.filter(~F.col("_old").eqNullSafe(F.col("_new")))
        changes = workspace.materialize(changes, "changes")
        kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("changed")
        done = {r["kind"]: r["count"] for r in changes.groupBy(kind.alias("kind")).count().collect()}
        report = {k: done.get(k, 0) for k in ("added", "changed", "deleted")}
        if not done:
            return report

        plus = now.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.lit(1).cast("long").alias("n"))
        if first:
            delta = plus
        else:
            plus = plus.join(changes.filter("_new IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
            touched = [r["b"] for r in changes.filter("_old IS NOT NULL").select(self._bucket("doc_id").alias("b")).distinct().collect()]  # at most all buckets
            minus = self._read("records", touched).join(changes.filter("_old IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
            delta = workspace.materialize(plus.unionAll(minus.select("doc_id", "term", -F.col("tf"), -F.col("n"))), "signed")
        prints = changes.select(
            "doc_id", F.coalesce("_old", F.lit(0)).bitwiseXOR(F.coalesce("_new", F.lit(0))).alias("fingerprint"),
            (F.col("_new").isNotNull().cast("long") - F.col("_old").isNotNull().cast("long")).alias("n"),
        )
        signed = _net("counts", delta.select("term", F.col("tf").alias("occurrences"), F.col("n").alias("records")))
        self._commit({"counts": signed, "records": delta, "prints": prints})
        return report

    def _commit(self, deltas: dict[str, DataFrame]) -> None:
        """Write the deltas, merge the buckets that have become many segments, and put the new manifest in force."""
        after = self.manifest | {"change": self.manifest["change"] + 1}
        for table, rows in deltas.items():
            added = self._write(table, rows)
            after[table] = {b: [*self.manifest[table].get(b, []), *([added[b]] if b in added else [])] for b in self.manifest[table].keys() | added.keys()}
            full = [int(b) for b, segments in after[table].items() if len(segments) > SEGMENTS]
            if full:
                merged = self._write(table, self._read(table, full, after))
                after[table] = {b: s for b, s in after[table].items() if int(b) not in full} | {b: [segment] for b, segment in merged.items()}
        workspace.write_new(self.spark, self._manifest_path(after["change"]), json.dumps(after))
        self.manifest = after

    def vacuum(self) -> int:
        """Remove what the newest manifest doesn't name: segments of dead or merged changes, and older manifests. Not while a change runs. Returns how many."""
        self.manifest = self._newest() or self.manifest
        kept = {f"{table}/segment={s}" for table in _SCHEMA for segments in self.manifest[table].values() for s in segments}
        there = [f"{table}/{name}" for table in _SCHEMA for name in workspace.names_in(self.spark, f"{self.path}/{table}")]
        gone = [f"{self.path}/{x}" for x in there if x not in kept]
        gone += [f"{self.path}/manifests/{name}" for name in workspace.names_in(self.spark, f"{self.path}/manifests") if name != f"{self.manifest['change']:012d}.json"]
        for where in gone:
            workspace.drop(self.spark, where)
        return len(gone)


def marked(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.75) -> DataFrame:
    """(term, mark): ``rare`` for terms held by fewer than ``rare_below`` records, ``common`` for those held by more than that share of all.

    A term that is both (in a collection of one or two records) has a row for each.
    """
    rare = F.when(F.col("records") < rare_below, F.lit("rare"))
    common = F.when(F.col("records") > F.lit(common_above) * F.lit(n_records), F.lit("common"))
    return counts.select("term", F.explode(F.array_compact(F.array(rare, common))).alias("mark"))
