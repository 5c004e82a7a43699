"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets an exponential key -ln(u) / quality with u from a digest of its id.  Within
a source, documents with small keys come first.  A source's target is met by whole epochs over
the source and then by the documents whose prefix sum of sizes, in key order, stays within what
is left; the one that crosses the budget gives only the words that are still wanted.

A source may hold any share of the rows, so no window ever runs over a source: keys fall into
``BINS`` ranges, bins are summed first, prefix sums run over bins, and the one bin in which a
source's budget ends is cut into ``BINS`` finer ones until it has ``SORTED`` rows at most, which are sorted.  Rows that tie in key, id and
size are put in order by a number of their own in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maqta.llm.common import WORD, drop_written, table, written

#: Bins of a level, as a power of two, and levels: a place has 48 bits.
BITS, LEVELS = 12, 4
BINS = 1 << BITS
#: Rows of a source that are sorted at most.
SORTED = 10_000
CAP = 3
#: Characters that count as junk in the quality weight.
JUNK = "0123456789#$%&*@<>{}[]|\\^~_=+/"
LEAST_QUALITY = 0.05
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """Number of words of a text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Share of characters that are not junk, ``LEAST_QUALITY`` at least (also for null and empty)."""
    share = F.length(F.translate(text, JUNK, "")) / F.nullif(F.length(text), F.lit(0))
    return F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(LEAST_QUALITY))


def keyed(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> dict[str, Column]:
    """Column expressions for size, key and bin of each document."""
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    key = -F.ln((drawn + F.lit(1)) / F.lit(float(2**52 + 2))) / quality(F.col(text))
    return {"size": words(F.col(text)), "key": key, "id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "source": F.col(source)}


def with_place(df: DataFrame) -> DataFrame:
    """Adds place, 48 bits that do not fall as the key grows, and turn, 48 bits that tell rows with equal keys apart.

    The result must be stored before it is read twice, since turn counts rows.
    """
    place = F.floor(F.col("key") / (1 + F.col("key")) * float(1 << (BITS * LEVELS))).cast("long")
    own = F.xxhash64(F.monotonically_increasing_id())
    return df.withColumn("place", F.least(place, F.lit((1 << (BITS * LEVELS)) - 1))).withColumn("turn", own)


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target: shares by weight of all words, none above ``CAP`` times its source.

    Sorted by the level at which they meet their cap, sources below the common level are capped;
    the level is the greatest of (what is left) / (weights left) over that order.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")))
    before = W.orderBy(CAP * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(CAP * F.col("source_size")).over(before), F.lit(0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return per.select("source", "source_size", F.least(F.col("w") * F.col("level"), (CAP * F.col("source_size")).cast("double")).alias("target"))


def _narrow(rows: DataFrame, want: DataFrame, at: str, weight: str, name: str) -> DataFrame:
    """s, low, high, before, rest: for each source the range of ``at`` (48 bits) in which its weights, summed up, pass ``rest``.

    rows: s, at, weight; want: s, rest, a row per source.  ``before`` is the weight below the range.  Ranges shrink until
    they hold ``SORTED`` rows or all their rows are at one place.  Sources whose weights do not pass ``rest`` have no row.
    """
    whole = 1 << (BITS * LEVELS)
    state = want.select("s", F.lit(0).cast("long").alias("low"), F.lit(whole).alias("high"), F.lit(0).cast("long").alias("before"), "rest")
    for level in range(1, LEVELS + 1):
        step = 1 << (BITS * (LEVELS - level))
        inside = rows.join(state.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_")) & (F.col(at) >= F.col("low")) & (F.col(at) < F.col("high")))
        bins = inside.groupBy("s", "before", "rest", F.floor(F.col(at) / step).cast("long").alias("bin")).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"))
        up_to = F.col("before") + F.sum("w").over(W.partitionBy("s").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        ends = bins.withColumn("up_to", up_to).where("up_to > rest").groupBy("s", "rest").agg(F.min_by(F.struct("bin", (F.col("up_to") - F.col("w")).alias("before"), "n"), "bin").alias("e"))
        state = written(ends.select("s", (F.col("e.bin") * step).alias("low"), ((F.col("e.bin") + 1) * step).alias("high"), F.col("e.before").alias("before"), "rest", F.col("e.n").alias("n")), name)
        if not state.where(F.col("n") > SORTED).head(1):
            break
    return state.drop("n")


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: target, epochs, and the place in key order at which its budget ends.

    sized: source, id, size, key, place, turn, stored.
    """
    t = targets(sized, weights).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    t = t.withColumn("rest", F.greatest("rest", F.lit(0).cast("long")))
    t = written(t, "mix-targets")
    rows = sized.withColumnRenamed("source", "s")
    ends = _narrow(rows, t.select(F.col("source").alias("s"), "rest"), "place", "size", "mix-ends")
    inside = rows.join(ends.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    # Rows that tie are one entry here, however many they are.
    tied = inside.groupBy("s", "before", "rest", "key", "id", "size").agg(F.sum("size").alias("w"))
    so_far = F.col("before") + F.sum("w").over(W.partitionBy("s").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0))
    tied = tied.withColumn("so_far", so_far).where("so_far > rest")
    first = tied.groupBy("s").agg(F.min(F.struct("key", "id", "size", (F.col("rest") - F.col("so_far") + F.col("w")).alias("left"))).alias("x"))
    # Of the tied rows ``whole`` give all their words and the next in turn gives ``part``.
    first = first.select("s", F.col("x.key").alias("end_key"), F.col("x.id").alias("end_id"), F.col("x.size").alias("end_size"), F.floor(F.col("x.left") / F.col("x.size")).cast("long").alias("whole"), (F.col("x.left") % F.col("x.size")).alias("part"))
    first = written(first, "mix-first")
    same = F.col("s").eqNullSafe(F.col("s_")) & (F.col("key") == F.col("end_key")) & (F.col("id") == F.col("end_id")) & (F.col("size") == F.col("end_size"))
    twins = rows.join(first.withColumnRenamed("s", "s_"), same).select("s", "whole", "turn", F.shiftrightunsigned("turn", 64 - BITS * LEVELS).alias("at"), F.lit(1).cast("long").alias("one"))
    twins = written(twins, "mix-twins")
    last = _narrow(twins, first.select("s", F.col("whole").alias("rest")), "at", "one", "mix-turns")
    close = twins.join(last.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    number = F.col("before") + F.row_number().over(W.partitionBy("s").orderBy("at", "turn")) - 1
    close = close.withColumn("number", number).where("number = rest").select("s", F.struct("at", "turn").alias("end_turn"))
    first = first.drop("whole").join(close.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    out = t.join(first, t["source"].eqNullSafe(first["s"]), "left").drop("s")
    out = written(out.withColumnRenamed("source", "plan_source"), "mix-plan")
    drop_written(t, twins)
    return out


def taken(df: DataFrame, plan: DataFrame) -> DataFrame:
    """df (source, id, size, key, turn, ...) with source_size, target, epochs (whole repeats), more, taken."""
    out = df.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left")
    here, end = F.struct("key", "id", "size"), F.struct(F.col("end_key").alias("key"), F.col("end_id").alias("id"), F.col("end_size").alias("size"))
    turn = F.struct(F.shiftrightunsigned("turn", 64 - BITS * LEVELS).alias("at"), "turn")
    early = F.col("end_key").isNull() | (here < end) | ((here == end) & (turn < F.col("end_turn")))
    crossing = (here == end) & (turn == F.col("end_turn"))
    more = F.when(F.col("rest") <= 0, 0).when(early, F.col("size")).when(crossing, F.col("part")).otherwise(0)
    return out.withColumn("more", F.coalesce(more, F.lit(0)).cast("long")).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("more")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Null and empty texts have size 0 and are never taken; null is a source of its own, after all
    others.  A null doc_id draws the key of an empty id.  Rows that tie in key, id and size, as repeated
    rows do, are taken one by one until the budget is met.  Texts of any length count whole.  An empty
    table gives an empty result.  Columns besides doc_id, text and source are ignored.
    """
    k = keyed(docs)
    sized = docs.select("doc_id", *(v.alias(n) for n, v in k.items()))
    sized = written(with_place(sized), "mix-sized")
    out = taken(sized, mix_plan(sized, weights))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: one row per repeat, untouched columns.

    The document that crosses its source's budget stays whole if at least half of it is wanted.
    """
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), *(v.alias(n) for n, v in keyed(docs).items()))
    sized = written(with_place(rows), "mix-sized")
    out = taken(sized, mix_plan(sized.drop("row"), weights))
    # A document without words is no part of a mix, however often its source is taken.
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + F.when(F.col("more") * 2 >= F.col("size"), F.sign("more")).otherwise(0))
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return out.select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 1) / 4503599627370498.0::DOUBLE)
      / greatest(coalesce(length(translate(text, '0123456789#$%&*@<>{}[]|\^~_=+/', ''))::DOUBLE / nullif(length(text), 0), 0.0), 0.05::DOUBLE) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source),
lev AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS l
  FROM per WINDOW b AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tar AS (SELECT source, source_size, least(w * max(l) OVER (), CAST(3 * source_size AS DOUBLE)) AS target FROM lev),
epo AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM tar),
run AS (SELECT doc_id, size, source_size, target, epochs, greatest(CAST(floor(target) AS BIGINT) - epochs * source_size, 0) AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY key, coalesce(doc_id, -9223372036854775808), size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN epo e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM run
"""
