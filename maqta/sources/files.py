"""Reading documents, and writing chunks as text, JSON and JSON lines."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.operators.segments import CHUNK_COLUMNS


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's address) and text of whole UTF-8 files; line ends become U+000A."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("doc_id"), F.regexp_replace("value", F.lit("\r\n?"), F.lit("\n")).alias("text"))


def from_text(spark: SparkSession, text: str, doc_id: str = "-") -> DataFrame:
    return spark.createDataFrame([(doc_id, text)], "doc_id string, text string")


def read_stdin(spark: SparkSession) -> DataFrame:
    return from_text(spark, sys.stdin.read())


def read_table(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text of a Parquet table."""
    return spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def as_dict(chunks: DataFrame) -> DataFrame:
    """doc_id, index, json: each chunk as an object with all its fields, nulls included."""
    fields = [c for c in CHUNK_COLUMNS if c != "doc_id"]
    return chunks.select("doc_id", "index", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def json_array(chunks: DataFrame) -> DataFrame:
    """doc_id, json: a document's chunks in order as one indented array."""
    fields = [c for c in CHUNK_COLUMNS if c != "doc_id"]
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", F.struct(*fields).alias("c")))).alias("a"))
    return rows.select("doc_id", F.to_json(F.col("a.c"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def hierarchical_json(tiers: DataFrame) -> DataFrame:
    """doc_id, json: one object with a document's parents and children."""
    fields = [c for c in CHUNK_COLUMNS if c != "doc_id"]
    own = lambda tier: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == tier, F.struct("index", F.struct(*fields).alias("c"))))), lambda x: x["c"])
    rows = tiers.groupBy("doc_id").agg(own("parent").alias("parents"), own("chunk").alias("children"))
    return rows.select("doc_id", F.to_json(F.struct("parents", "children"), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def as_text(chunks: DataFrame) -> DataFrame:
    """doc_id, index, line: a chunk's header and text for people."""
    path = F.when(F.size("headings") > 0, F.concat(F.lit(" · "), F.array_join("headings", " › "))).otherwise(F.lit(""))
    head = F.format_string("── chunk %d · %d tokens%s ──", "index", "token_count", path)  # fixed format
    return chunks.select("doc_id", "index", F.concat(head, F.lit("\n"), "text", F.lit("\n")).alias("line"))


def write_jsonl(chunks: DataFrame, path: str) -> None:
    chunks.write.option("ignoreNullFields", "false").json(path)


def write_text(chunks: DataFrame, path: str) -> None:
    as_text(chunks).repartitionByRange("doc_id", "index").sortWithinPartitions("doc_id", "index").select("line").write.text(path)
