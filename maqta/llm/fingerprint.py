"""Document fingerprints by consistent weighted sampling (gamma-based).

A text is a weighted set: its word pairs, each with the number of times it occurs.  For every
term and sample k there are r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), drawn from the term's hash.
With weight S the term's level is t = floor(ln S / r + b), and it offers the value
ln c - r (t - b) - r.  The term of least value gives the sample; two texts agree in a sample with a
probability equal to their generalised Jaccard similarity, the sum of least weights by the sum of
greatest.

A sample is kept as 16 bits of the winning term and level, so texts that share nothing agree
with a chance of 1 in 65,536 a sample.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.llm.common import GOLDEN, MIX1, MIX2, mix64, partitions, place_table, table, tidy, word_hash

SAMPLES = 96
#: Terms that are drawn for at once.
BLOCK = 512
SEED = 9
EMPTY = "0" * (4 * SAMPLES)
_LETTERS = place_table(SEED)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Sampler:
    """Random numbers of each term and sample from the term's 64-bit hash alone, the same on every machine.

    With g, g' and e exponential, c = g + g' and g / c are a Gamma(2, 1) and an independent Uniform(0, 1), and so are
    r = ln(c / g) + e and 1 - b = ln(c / g) / r.  Then the value of level t is ln g - r t: a term of weight 1, whose level
    is 0, offers g, the least of which has the greatest hash, and only terms of greater weight need r.
    """

    _made: "Sampler | None" = None

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self.keys = mix64((np.arange(1, samples + 1, dtype=np.uint64) + np.uint64(SEED << 32)) * GOLDEN)

    @classmethod
    def shared(cls) -> "Sampler":
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def hashes(self, terms: np.ndarray) -> np.ndarray:
        """64 bits of each term in each sample; terms that differ have bits that differ."""
        x = mix64(terms)[:, None] ^ self.keys
        x *= MIX1
        x ^= x >> np.uint64(32)
        x *= MIX2
        return x

    def weighted(self, x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the value, and the level, of terms with hashes ``x`` and any weights."""
        y = mix64(x)
        g = _exponential(x)
        u = np.log1p(_exponential(y) / g)  # ln(c / g)
        r = u + _exponential(mix64(y + GOLDEN))
        level = np.floor((np.log(weights)[:, None] - u) / r + 1)
        return g * np.exp(-r * level), level

    def signature(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """16 bits per sample of the term and level that offered the least value."""
        once = terms[weights == 1]
        most = np.zeros(self.samples, np.uint64)
        for lo in range(0, len(once), BLOCK):
            most = np.maximum(most, self.hashes(once[lo : lo + BLOCK]).max(axis=0))
        least = _exponential(most) if len(once) else np.full(self.samples, np.inf)
        mark = most
        many, column = np.flatnonzero(weights != 1), np.arange(self.samples)
        for lo in range(0, len(many), BLOCK):
            i = many[lo : lo + BLOCK]
            x = self.hashes(terms[i])
            value, level = self.weighted(x, weights[i])
            at = value.argmin(axis=0)
            value, own = value[at, column], x[at, column] + level[at, column].astype(np.int64).view(np.uint64) * GOLDEN
            least, mark = np.where(value < least, value, least), np.where(value < least, own, mark)
        return (mix64(mark) >> np.uint64(48)).astype(np.uint16)


def _exponential(x: np.ndarray) -> np.ndarray:
    """Exponential numbers of 64-bit hashes, less for greater ones."""
    return -np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)


def weighted_terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's word pairs (a lone word stands for itself) and their counts."""
    a = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = ~_SPACE[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hash(a, start, end, _LETTERS)
    return np.unique(h if len(h) == 1 else mix64(h[:-1] * GOLDEN + h[1:]), return_counts=True)


def fingerprint(text: str) -> str:
    """Hex signature of a text; a text without words has that of zeros."""
    terms, weights = weighted_terms(text.encode())
    return Sampler.shared().signature(terms, weights).astype(">u2").tobytes().hex() if len(terms) else EMPTY


def likeness(a: str, b: str) -> float:
    """Share of samples in which two fingerprints agree; texts without words are like each other only."""
    if a == EMPTY or b == EMPTY:
        return float(a == b)
    x, y = np.frombuffer(bytes.fromhex(a), np.uint16), np.frombuffer(bytes.fromhex(b), np.uint16)
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, head): documents dealt into ranges of doc_id, each range followed by the first
    document of the next one (head is true).

    Range bounds come from quantiles of doc_id, one number per range.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    found = ids.select("doc_id").where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    bounds = sorted({int(x) for x in found}, reverse=True)
    # Parts count up as doc_id goes down; null ids come last of all.
    at = F.lit(0) if not bounds else F.array_size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b > F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))
    ids = ids.withColumn("part", at.cast("int"))
    first = ids.groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()  # a row per range
    follower = {row["part"]: first[(i + 1) % len(first)] for i, row in enumerate(first)} if first else {}
    pieces = [ids.withColumn("head", F.lit(False))]
    if first:
        wanted = spark.createDataFrame([(p, f["part"], f["doc_id"]) for p, f in follower.items()], "to_part int, f_part int, f_id long")
        heads = ids.join(F.broadcast(wanted), (F.col("part") == F.col("f_part")) & F.col("doc_id").eqNullSafe(F.col("f_id")))
        heads = heads.groupBy(F.col("to_part").alias("part"), "doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", "part", F.lit(True).alias("head"))
        pieces.append(heads)
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out.repartition(n, "part").sortWithinPartitions("part", "head", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Null texts are empty.  Rows go by descending doc_id, null ids last, and rows of one id by
    descending text; the row after the last is the first.  A single row follows itself.
    """

    def run(batches):
        before = None  # (part, doc_id, text, fingerprint): the row that waits for the one after it
        for batch in batches:
            rows = []
            for doc_id, text, part, head in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mark = fingerprint(text)
                if before is not None and before[0] == part:
                    _, d, t, m = before
                    e = edited(t, text)
                    em = m if e == t else fingerprint(e)
                    rows.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), m, em, likeness(m, em), likeness(m, mark)))
                before = None if head else (part, doc_id, text, mark)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(tidy(run), SCHEMA)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
