"""Collections of documents from directories of text and JSON files, and from tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiquarry.functions.analysis import WHITE
from lexiquarry.workspace import _fs, materialize

JSON_DOCUMENT = StructType([StructField(name, StringType()) for name in ("title", "body", "url")])


def _file_columns():
    return F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("byte_size")


_EMPTY = re.compile(r"FileStatus\{path=([^;]*); isDirectory=false; length=0;")


def _empty_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, path) of the files without bytes in a folder, which Spark's readers leave out. The listing comes over as one text, not a call for each file."""
    where, fs = _fs(spark, path)
    listed = spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(where)) if fs.exists(where) else ""
    return [(name, found) for found in _EMPTY.findall(listed) for name in (found.rpartition("/")[2],) if not name.startswith((".", "_"))]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, title, body, url, byte_size) of the files without the ending ``.json``: the body is the whole file, the title its path, the url empty. An empty file is an empty document."""
    files = spark.read.text(path, wholetext=True).filter(~F.endswith(F.col("_metadata.file_name"), F.lit(".json")))
    read = files.select(_file_columns()[0], F.col("_metadata.file_path").alias("title"), F.col("value").alias("body"), F.lit("").alias("url"), _file_columns()[1])
    empty = [(name, found, "", "", 0) for name, found in _empty_files(spark, path) if not name.endswith(".json")]
    return read.unionAll(spark.createDataFrame(empty, "file_name string, title string, body string, url string, byte_size long")) if empty else read


def read_json(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The same of the ``.json`` files, one object with title, body and url each; runs of white space in the body become one space, and one ends it.

    Missing fields are null, other ones are ignored; ``mode`` says what becomes of a broken file.
    """
    files = spark.read.schema(JSON_DOCUMENT).option("multiLine", True).option("mode", mode).option("pathGlobFilter", "*.json").json(path)
    body = F.concat(F.trim(F.regexp_replace("body", WHITE, " ")), F.lit(" "))
    return files.select(_file_columns()[0], "title", body.alias("body"), "url", _file_columns()[1])


def number(files: DataFrame, by: str = "file_name") -> DataFrame:
    """Add doc_id LONG, 0, 1, ... in the order of ``by``, without sorting in one task.

    Rows are range partitioned and numbered within partitions; the partitions' offsets come from their counts.
    """
    ordered = files.repartitionByRange(by).sortWithinPartitions(by)
    placed = materialize(ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row per partition
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["_part"], total))
        total += row["n"]
    start = files.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return placed.join(F.broadcast(start), "_part").select((F.col("_start") + F.col("_row")).alias("doc_id"), *files.columns)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, file_name, title, body, url, byte_size) of a directory, not of those below it; ids follow the file names."""
    return number(read_text(spark, path).unionByName(read_json(spark, path)))


def read_classes(spark: SparkSession, directories: dict[str, str], unlabelled: str | None = None) -> DataFrame:
    """Documents of one directory per class, with their ``class``; those of ``unlabelled`` have none. Ids are unique over all."""
    each = [(name, path) for name, path in directories.items()] + ([(None, unlabelled)] if unlabelled else [])
    parts = [read_text(spark, p).unionByName(read_json(spark, p)).withColumn("class", F.lit(c).cast("string")) for c, p in each]
    keyed = reduce(DataFrame.unionByName, parts).withColumn("_order", F.concat_ws("/", F.coalesce("class", F.lit("")), "file_name"))
    return number(keyed, "_order").drop("_order")


def from_table(table: DataFrame, doc_id: str = "doc_id", body: str = "text", **columns: str) -> DataFrame:
    """Documents of a table; ``columns`` names the sources of file_name, title, url, byte_size and class."""
    fixed = {"doc_id": F.col(doc_id).cast("long"), "body": F.col(body), "byte_size": F.coalesce(F.octet_length(body), F.lit(0)).cast("long"), "file_name": F.concat(F.lit("doc"), F.col(doc_id).cast("string"))}
    return table.select(*[e.alias(c) for c, e in (fixed | {c: F.col(s) for c, s in columns.items()}).items()])
