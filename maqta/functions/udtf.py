"""A table function for SQL: chunks of one text, for LATERAL use with functions of the caller's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession, name: str, split: Callable[[str], Iterator[tuple[int, int]]]) -> None:
    """Registers ``name(text)`` giving index, start, end, piece for the spans that ``split`` finds in a text."""

    class Pieces:
        def eval(self, text: str):
            for i, (a, b) in enumerate(split(text or "")):
                yield i, a, b, (text or "")[a:b]

    spark.udtf.register(name, udtf(Pieces, returnType="index: int, start: int, end: int, piece: string"))
