"""Sections: lines, headings and the path of headings above each section.

Input everywhere is a DataFrame of (doc_id, text); offsets count code points from 0.  Everything is windowed by
document, so after one exchange by ``doc_id`` no step shuffles again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maqta.functions.text import detect_heading, strip

LINE_BREAK = r"(?<=\n|\r(?!\n)|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
LEVELS = range(1, 7)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_idx, start, line: lines with their ends; the lines of a text put together are the text."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_BREAK, -1)).alias("line_idx", "line")).where("line <> ''")
    before = W.partitionBy("doc_id").orderBy("line_idx").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line")).over(before), F.lit(0))
    return cut.select("doc_id", "line_idx", start.cast("int").alias("start"), "line")


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_idx, start, heading, level of the lines that are headings."""
    found = lines(docs).withColumn("h", detect_heading("line")).where("h is not null")
    return found.select("doc_id", "line_idx", "start", "h.heading", "h.level")


def sections(docs: DataFrame, respect_structure: bool = True) -> DataFrame:
    """doc_id, section_idx, start, end, headings, level, heading_start, body.

    A heading closes the section before it and stays on the path of what follows until a heading of its
    level or above comes.  On the path, then, is the last heading of each level that stands after the last
    heading of every higher level: no stack is needed.  Sections of white space alone are dropped and
    section_idx counts the others.
    """
    if not respect_structure:
        whole = docs.select("doc_id", F.lit(0).alias("raw_idx"), F.lit(0).alias("start"), F.coalesce("text", F.lit("")).alias("body"), F.array().cast("array<string>").alias("headings"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("heading_start"))
    else:
        by_doc = W.partitionBy("doc_id").orderBy("line_idx")
        marked = lines(docs).withColumn("h", detect_heading("line"))
        marked = marked.withColumn("raw_idx", F.sum(F.col("h").isNotNull().cast("int")).over(by_doc))
        for n in LEVELS:
            at = F.when(F.col("h.level") == n, F.struct(F.col("line_idx").alias("at"), F.col("h.heading").alias("heading")))
            marked = marked.withColumn(f"last{n}", F.last(at, ignorenulls=True).over(by_doc))
        on_path = []
        for n in LEVELS:
            above = [F.col(f"last{k}.at") for k in range(1, n)]
            higher = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
            on_path.append(F.when(F.col(f"last{n}.at") > higher, F.col(f"last{n}.heading")))
        marked = marked.withColumn("path", F.array_compact(F.array(*on_path)))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNull(), F.struct("line_idx", "line")))), lambda x: x["line"]), "")
        whole = marked.groupBy("doc_id", "raw_idx").agg(
            F.coalesce(F.min(F.when(F.col("h").isNull(), F.col("start"))), F.max(F.col("start") + F.length("line"))).alias("start"),
            body.alias("body"), F.max("path").alias("headings"), F.coalesce(F.max("h.level"), F.lit(0)).alias("level"), F.min(F.when(F.col("h").isNotNull(), F.col("start"))).alias("heading_start"),
        )
    kept = whole.where(strip("body") != "")
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("raw_idx")) - 1
    return kept.select("doc_id", idx.alias("section_idx"), "start", (F.col("start") + F.length("body")).alias("end"), "headings", "level", "heading_start", "body")

