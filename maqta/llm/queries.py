"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maqta.llm import fingerprint, jaccard, langid, line_dedup, mixing, packing, suffix, tiff, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": jaccard.op1_jaccard_join,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_warc": warc.op4_warc,
        "op5_language_id": langid.op5_language_id,
        "op6_pack": packing.op6_pack,
        "op7_media_tiff": tiff.op7_media_tiff,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_fingerprints": fingerprint.op9_fingerprints,
        "op10_suffix_dedup": suffix.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": jaccard.OP1_SQL, "op2_mix_sources": mixing.OP2_SQL, "op3_line_dedup": line_dedup.OP3_SQL, "op4_warc": warc.OP4_SQL}
