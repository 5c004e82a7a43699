"""Structure-aware chunking for Arabic text on Spark.  Public names load what they need when first used."""

_HOME = {
    "Chunker": "plans.chunker", "children": "plans.chunker", "children_of": "plans.chunker", "ChunkConfig": "config",
    "HashingEmbedder": "operators.vectors", "CallableEmbedder": "operators.vectors", "MemoisingEmbedder": "operators.vectors", "SentenceTransformerEmbedder": "operators.vectors",
    "Length": "operators.sentences", "WORDS": "operators.sentences", "CHARACTERS": "operators.sentences", "sentences": "operators.sentences", "split_long": "operators.sentences", "units": "operators.sentences",
    "sections": "operators.structure", "headings": "operators.structure", "lines": "operators.structure",
    "normalize_arabic": "functions.text", "strip_diacritics": "functions.text", "light_stem": "functions.text", "stems": "functions.text", "words": "functions.text",
    "count_words": "functions.text", "is_arabic": "functions.text", "detect_heading": "functions.text", "discourse_bias": "functions.text",
    "chunk_quality": "operators.metrics", "pk": "operators.metrics", "window_diff": "operators.metrics",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
