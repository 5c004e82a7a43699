"""Command line: chunk a text file.  ``python -m maqta.cli FILE``; ``-`` reads standard input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maqta.config import ChunkConfig
from maqta.operators.metrics import chunk_quality
from maqta.operators.vectors import HashingEmbedder, SentenceTransformerEmbedder
from maqta.plans.chunker import Chunker
from maqta.sources import files


# Fixed interface: names of options and choices.
def parser() -> argparse.ArgumentParser:
    d, p = ChunkConfig(), argparse.ArgumentParser(prog="maqta", description="Split Arabic text where its topics change.")
    p.add_argument("file", help="text or Markdown file, or - for standard input")
    p.add_argument("--max-tokens", type=int, default=d.max_tokens)
    p.add_argument("--min-tokens", type=int, default=d.min_tokens)
    p.add_argument("--window", type=int, default=d.window)
    p.add_argument("--strategy", choices=["optimal", "greedy"], default=d.strategy)
    p.add_argument("--threshold-type", choices=["percentile", "std", "iqr"], default=d.threshold_type)
    p.add_argument("--threshold-amount", type=float)
    p.add_argument("--overlap", type=int, default=d.overlap_sentences, help="sentences repeated from the chunk before")
    p.add_argument("--no-structure", action="store_true", help="headings are text like any other")
    p.add_argument("--model", help="sentence-transformers model in place of the built-in vectors")
    p.add_argument("--hierarchical", type=int, metavar="PARENT_MAX", help="also make parents of that size; always JSON")
    p.add_argument("--format", choices=["text", "json", "jsonl"], default="text")
    p.add_argument("--stats", action="store_true", help="quality report on standard error")
    return p


def pretty(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def as_objects(chunks) -> list[dict]:
    """The chunks of the one document that the command reads, in order."""
    return [json.loads(r["json"]) for r in files.as_dict(chunks).orderBy("index").collect()]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    docs = files.read_stdin(spark) if a.file == "-" else files.read_text(spark, a.file)
    embedder = SentenceTransformerEmbedder(a.model) if a.model else HashingEmbedder()
    chunker = Chunker(embedder=embedder, max_tokens=a.max_tokens, min_tokens=a.min_tokens, window=a.window, strategy=a.strategy, threshold_type=a.threshold_type, threshold_amount=a.threshold_amount, overlap_sentences=a.overlap, respect_structure=not a.no_structure)
    if a.hierarchical:
        tiers = chunker.chunk_hierarchical(docs, a.hierarchical).persist()
        chunks = tiers.where("tier = 'chunk'").drop("tier")
        print(pretty({name: as_objects(tiers.where(F.col("tier") == tier)) for name, tier in (("parents", "parent"), ("children", "chunk"))}))
    else:
        tiers = chunks = chunker.chunk(docs).persist()
        if a.format == "json":
            print(pretty(as_objects(chunks)))
        elif a.format == "jsonl":
            for chunk in as_objects(chunks):
                print(json.dumps(chunk, ensure_ascii=False))
        else:
            for row in files.as_text(chunks).orderBy("doc_id", "index").toLocalIterator():
                print(row["line"])
    if a.stats:
        found = chunk_quality(chunks).drop("doc_id").first()
        print(json.dumps(found.asDict() if found else {"chunks": 0}, ensure_ascii=False), file=sys.stderr)
    tiers.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
