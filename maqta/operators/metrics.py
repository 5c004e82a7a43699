"""Segmentation metrics and chunk quality."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maqta.functions.text import NOT_S
from maqta.operators.vectors import HashingEmbedder, bounded


def mask(boundaries: Column, n: Column) -> Column:
    """For each gap 1 to n - 1 whether a segment starts there; others of the boundaries are ignored."""
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_contains(boundaries, i.cast("int")))).otherwise(F.array().cast("array<boolean>"))


def default_window(gold: Column, n: Column) -> Column:
    """Half the mean length of a gold segment, 2 at least; halves round to even."""
    segments = F.size(F.array_distinct(F.filter(gold, lambda b: (b > 0) & (b < n)))) + 1
    return F.greatest(F.lit(2), F.bround(n / segments / 2, 0).cast("int"))


@F.pandas_udf(T.StructType([T.StructField("pk", T.DoubleType()), T.StructField("wd", T.DoubleType())]))
def _disagreement(gold: pd.Series, pred: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
    """Shares of windows of k gaps in which one segmentation alone has a boundary, and in which their numbers differ.

    Boundaries before each gap are counted once; a window's number is a difference of two counts.
    """
    out = np.zeros((len(n), 2))
    for row, (g, p, size, width) in enumerate(zip(gold, pred, n, k, strict=True)):
        count = int(size) - int(width)
        if count <= 0:
            continue
        held = []
        for starts in (g, p):
            at = np.unique(np.asarray(starts, np.int64))
            mark = np.zeros(int(size) + 1, np.int64)
            mark[at[(at > 0) & (at < size)]] = 1
            upto = np.cumsum(mark)
            first = np.arange(1, count + 1)
            held.append(upto[np.minimum(first + int(width) - 1, int(size) - 1)] - upto[first - 1])
        out[row] = ((held[0] > 0) != (held[1] > 0)).mean(), (held[0] != held[1]).mean()
    return pd.DataFrame(out, columns=["pk", "wd"])


def _compare(gold: Column, pred: Column, n: Column, k: Column | int | None) -> Column:
    fallback = default_window(gold, n)
    width = fallback if k is None else F.coalesce(F.nullif(F.lit(k) if isinstance(k, int) else k, F.lit(0)), fallback)
    nothing = F.array().cast("array<int>")
    return _disagreement(F.coalesce(gold.cast("array<int>"), nothing), F.coalesce(pred.cast("array<int>"), nothing), F.coalesce(n, F.lit(0)).cast("int"), F.coalesce(width, F.lit(2)).cast("int"))


def pk(gold: Column, pred: Column, n: Column, k: Column | int | None = None) -> Column:
    """Beeferman's Pk of boundaries (arrays of segment starts) over n units: windows in which only one has a boundary."""
    return _compare(gold, pred, n, k)["pk"]


def window_diff(gold: Column, pred: Column, n: Column, k: Column | int | None = None) -> Column:
    """WindowDiff: windows in which the numbers of boundaries differ."""
    return _compare(gold, pred, n, k)["wd"]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ranks(starts: pd.Series, positions: pd.Series) -> pd.Series:
    rows = (np.unique(np.searchsorted(np.asarray(s, np.int64), [x for x in p if x > 0], "left")) for s, p in zip(starts, positions, strict=True))
    return pd.Series([r.astype(np.int32) for r in rows], dtype=object)


def to_units(starts: Column, positions: Column) -> Column:
    """Offsets as unit numbers: for each positive offset how many of the sorted starts are before it, once each."""
    return _ranks(starts.cast("array<int>"), positions.cast("array<int>"))


def _neighbours(embedder, texts: Iterable[list[str]]) -> Iterable[float | None]:
    """Mean cosine of the neighbours in each list of texts."""
    for m in embedder.rows(texts):
        yield float(np.einsum("ij,ij->i", m[:-1], m[1:]).mean()) if len(m) > 1 else None


def adjacent_similarity(rows: DataFrame, embedder=HashingEmbedder()) -> DataFrame:
    """The columns of ``rows`` with similarity in place of ``texts``, its last one: the mean cosine of neighbouring chunks, embedded anew document by document."""
    *kept, _ = rows.schema.fields

    def run(batches):
        waiting: deque = deque()

        def texts():
            for batch in bounded(batches):
                for k, own in enumerate(batch.column(len(kept)).to_pylist()):
                    waiting.append((batch, k))
                    yield own

        # A batch is handed on when the last of its rows is done.
        found = []
        for similarity in _neighbours(embedder, texts()):
            batch, k = waiting.popleft()
            found.append(similarity)
            if k == batch.num_rows - 1:
                yield pa.record_batch([*batch.columns[: len(kept)], pa.array(found, pa.float64())], names=[*(f.name for f in kept), "similarity"])
                found = []

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("similarity", T.DoubleType())]))


def chunk_quality(chunks: DataFrame, embedder=HashingEmbedder(), docs: DataFrame | None = None) -> DataFrame:
    """doc_id, chunks, mean_words, min_words, max_words, size_cv, mean_coherence, mean_adjacent_similarity.

    chunks: doc_id, index, text and, if there is one, coherence.  Words are runs without white space.  With ``docs``
    (doc_id) documents without a chunk have a row too, of 0 chunks and nulls.
    """
    size = F.regexp_count("text", F.lit(f"{NOT_S}+"))
    # Means of rounded numbers often lie just between two results, so they are taken exactly.
    coherence = F.avg(F.col("coherence").cast("decimal(12,8)")) if "coherence" in chunks.columns else F.lit(None).cast("double")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"])
    per = chunks.withColumn("size", size).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.bround(F.avg("size"), 1).alias("mean_words"), F.min("size").alias("min_words"), F.max("size").alias("max_words"),
        F.bround(F.stddev_pop("size") / F.coalesce(F.nullif(F.avg("size"), F.lit(0.0)), F.lit(1.0)), 3).alias("size_cv"), F.bround(coherence, 4).cast("double").alias("mean_coherence"),
        in_order.alias("texts"),
    )
    out = adjacent_similarity(per, embedder).withColumn("mean_adjacent_similarity", F.bround("similarity", 4)).drop("similarity")
    return out if docs is None else docs.select("doc_id").join(out, "doc_id", "left").na.fill(0, ["chunks"])
