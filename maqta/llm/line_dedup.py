"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host.  A line is boilerplate of a host if the pages that hold it, divided by all the host's
pages, are more than ``max_ratio``.  Each page counts a line once; a line on one page only repeats nothing and is
none.  Counts are summed before the shuffle, so a hot host or line costs one row per task.  A host has
at most (mean lines per page) / max_ratio boilerplate lines, which bounds the list that is
joined back to its pages.  Lines are told apart by 128 bits of digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.llm.common import table, written

MAX_RATIO = 0.05
#: Tasks that a host's pages are dealt out to when they meet its lines.
SALTS = 16


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user, port and a leading www; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, F.lit(r"^www\.|\.$"), F.lit("")), F.lit(""))


def boilerplate(pages: DataFrame, host: Column, text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """host_key, bad: the digests of each host's boilerplate lines, where it has any."""
    own = pages.select(host.alias("host_key"), F.col(text).alias("t"))
    total = own.groupBy("host_key").agg(F.count(F.lit(1)).alias("n_pages")).withColumnRenamed("host_key", "total_host")
    digests = F.array_distinct(F.transform(F.split("t", "\n", -1), lambda x: F.when(F.trim(x) != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))))
    lines = own.select("host_key", F.explode(digests).alias("line")).where(F.col("line").isNotNull())
    seen = lines.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("on_pages")).where(F.col("on_pages") > 1)
    seen = seen.join(total, F.col("host_key").eqNullSafe(F.col("total_host"))).where(F.col("on_pages") > max_ratio * F.col("n_pages"))
    return seen.groupBy("host_key").agg(F.collect_set("line").alias("bad"))


def _lines(rows: DataFrame, found: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows`` (page_host, ...) with bad_lines of their host; a host's rows are dealt out to ``salts`` tasks."""
    right = found.select(F.col("host_key").alias("bad_host"), F.col("bad").alias("bad_lines"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("bad_salt"))
    left = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return left.join(right, F.col("page_host").eqNullSafe(F.col("bad_host")) & (F.col("_salt") == F.col("bad_salt")), "left").drop("_salt", "bad_host", "bad_salt")


def dedup_lines(pages: DataFrame, host: Column | None = None, text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and n_lines, n_dropped.

    Lines end at U+000A.  Blank lines are never dropped.  Null text stays null with 0 lines; an
    empty text is one blank line.  A null host is a host of its own.  Repeated rows are pages of
    their own.  Texts may be of any length.  An empty table gives an empty result.  Other columns stay;
    columns of ``pages`` named n_lines and n_dropped give way to the new ones.
    """
    host = F.col("source") if host is None else host
    bad = written(boilerplate(pages, host, text, max_ratio), "lines")
    names = pages.columns
    rows = pages.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), host.alias("page_host"))
    rows = _lines(rows, bad)
    lines = F.split(F.col(f"row.{text}"), "\n", -1)
    digest = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    kept = F.filter(F.col("lines"), lambda x: (F.trim(x) == "") | ~F.array_contains("bad_lines", digest(x)))
    rows = rows.withColumn("lines", lines).withColumn("kept", F.when(F.col("bad_lines").isNull(), F.col("lines")).otherwise(kept))
    fresh = F.array_join("kept", "\n")
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    n_kept = F.coalesce(F.size("kept"), F.lit(0))
    return rows.select(
        *(fresh.alias(n) if n == text else F.col(f"row.`{n}`").alias(n) for n in names if n not in ("n_lines", "n_dropped")),
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.greatest(n_lines - n_kept, F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are boilerplate of its source, which is its site."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS n FROM d GROUP BY source),
seen AS (SELECT source, line, count(DISTINCT r) AS c FROM l WHERE trim(line, ' ') <> '' GROUP BY source, line),
bad AS (SELECT s.source, line FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source WHERE c > 1 AND c > 0.05::DOUBLE * n),
f AS (SELECT l.*, b.line IS NOT NULL AS dropped FROM l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
g AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS t, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped FROM f GROUP BY r)
SELECT d.doc_id, g.t AS text, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped FROM d LEFT JOIN g USING (r)
"""
