"""The chunker: documents in, chunks out, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maqta.config import ChunkConfig
from maqta.operators.segments import CHUNK_COLUMNS, chunks_of
from maqta.operators.sentences import Length, as_length
from maqta.operators.vectors import HashingEmbedder


class Chunker:
    """Splits the texts of (doc_id, text) where topics change, within a budget.

    doc_id must be unique and not null; null texts are empty and give no chunk.  The budget is in words unless
    ``length_function`` says otherwise: any function from a text to a whole number, or a ``Length``.
    """

    def __init__(self, config: ChunkConfig | None = None, embedder=None, length_function: Length | Callable[[str], int] | None = None, **settings) -> None:
        self.config = replace(config, **settings) if config else ChunkConfig(**settings)
        self.embedder = embedder or HashingEmbedder()
        self.length = as_length(length_function)

    def _tiers(self, docs: DataFrame, config: ChunkConfig) -> DataFrame:
        return chunks_of(docs, config, self.embedder, self.length)

    def chunk(self, docs: DataFrame) -> DataFrame:
        """Chunks of every document, ``CHUNK_COLUMNS``."""
        return self._tiers(docs, replace(self.config, parent_max_tokens=None)).select(*CHUNK_COLUMNS)

    def split_text(self, docs: DataFrame) -> DataFrame:
        """doc_id, index, text."""
        return self.chunk(docs).select("doc_id", "index", "text")

    def chunk_hierarchical(self, docs: DataFrame, parent_max_tokens: int = 1024, parent_min_tokens: int | None = None) -> DataFrame:
        """Parents and chunks in one table, told apart by tier; a chunk's parent_id is its parent's index."""
        config = replace(self.config, parent_max_tokens=parent_max_tokens, parent_min_tokens=parent_min_tokens)
        return self._tiers(docs, config).select("tier", *CHUNK_COLUMNS)


def children_of(tiers: DataFrame, doc_id, parent_id: int) -> DataFrame:
    """The chunks of one parent."""
    return tiers.where((F.col("tier") == "chunk") & (F.col("doc_id") == doc_id) & (F.col("parent_id") == parent_id))


def children(tiers: DataFrame) -> DataFrame:
    """doc_id, parent_id, child_index of all parents."""
    return tiers.where("tier = 'chunk' and parent_id is not null").select("doc_id", "parent_id", F.col("index").alias("child_index"))
