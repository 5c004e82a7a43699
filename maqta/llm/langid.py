"""Language ID by hyperdimensional profiles.

Each letter, known by its code point, has a random vector of +1 and -1, as have the places between words.  A trigram's vector
binds (multiplies) those of its letters after permuting (rotating) the first twice and the second once.  A document's
vector bundles (sums) its trigram vectors; a language's prototype bundles the unit vectors of
labelled documents.  The prediction is the prototype of greatest cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.llm.common import GOLDEN, mix64, table, tidy
from maqta.llm.letters import letters

DIMENSIONS = 512
SEED = 5
#: Labelled rows that prototypes are learned from, about: rows whose hash falls below a threshold.
SAMPLE = 16384
UNKNOWN = "und"

#: Trigrams whose vectors are made at once.
BLOCK = 1024


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The vectors of code points (0: between words), from the code points alone, the same on every machine."""
    blocks = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64) * GOLDEN + np.uint64(SEED << 40)
    drawn = mix64(mix64(points.astype(np.uint64) + np.uint64(1))[:, None] ^ blocks)
    bits = np.unpackbits(drawn.astype("<u8").view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def bundle(text: str) -> np.ndarray | None:
    """Sum of the vectors of a text's trigrams, whole numbers; none without letters."""
    points = letters(text)
    if len(points) < 3:
        return None
    alphabet, x = np.unique(points, return_inverse=True)
    n, v = len(alphabet), letter_vectors(alphabet)
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    grams, counts = np.unique((x[:-2] * n + x[1:-1]) * n + x[2:], return_counts=True)
    out = np.zeros(DIMENSIONS)
    for lo in range(0, len(grams), BLOCK):
        g = grams[lo : lo + BLOCK]
        bound = first[g // (n * n)]
        bound *= second[g // n % n]
        bound *= v[g % n]
        part = counts[lo : lo + BLOCK]
        wide = np.float32 if part.sum() < 1 << 24 else np.float64  # sums stay exact
        out += part.astype(wide) @ bound.astype(wide)
    return out


def profile(text: str | None) -> np.ndarray | None:
    """Unit vector of a text; none without letters."""
    out = bundle(text) if text else None
    if out is None:
        return None
    norm = np.linalg.norm(out)
    return out / norm if norm else out


@dataclass(frozen=True)
class Prototypes:
    names: tuple[str, ...]
    vectors: np.ndarray  # a unit row per language

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and cosine (0 at least); unknown with 0 for a text without letters or without any prototype."""
        v = profile(text) if self.names else None
        if v is None:
            return UNKNOWN, 0.0
        cos = self.vectors @ v
        best = int(np.argmax(cos))
        return self.names[best], min(1.0, max(0.0, float(cos[best])))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is a multiple of 5 (null: of an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, sample: int = SAMPLE) -> Prototypes:
    """Prototypes from about ``sample`` rows that are not held out and have a language and a text."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = docs.select("doc_id", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                v = profile(text.as_py())
                if v is not None:
                    k = lang.as_py()
                    sums[k] = sums[k] + v if k in sums else v
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "total"])

    def merge(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in group.column("total"))
        return pa.table({"lang": group.column("lang")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("lang", "text").mapInArrow(tidy(run), "lang string, total binary").groupBy("lang").applyInArrow(merge, "lang string, total binary")
    made = sorted((r["lang"], np.frombuffer(r["total"], np.float64)) for r in found.collect())  # a row per language
    made = [(k, v / np.linalg.norm(v)) for k, v in made if np.linalg.norm(v)]
    return Prototypes(tuple(k for k, _ in made), np.array([v for _, v in made]).reshape(len(made), DIMENSIONS))


def predict(docs: DataFrame, prototypes: Prototypes, keep: bool = False) -> DataFrame:
    """lang_pred and score of every row; with ``keep`` all columns of ``docs`` come first, else doc_id alone.

    Null and letterless texts are ``und`` with score 0.  Texts of any length are read whole.  Repeated rows get equal answers, each
    its own row; of prototypes with equal cosines the first by name is taken.  An empty table gives an empty result.
    """
    names = [n for n in docs.columns if n not in ("lang_pred", "score")] if keep else ["doc_id"]
    rows = docs.select(*(F.col(f"`{n}`") for n in names), F.col("text").alias("_text_in"))
    known = prototypes

    def run(batches):
        for batch in batches:
            found = [known.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
