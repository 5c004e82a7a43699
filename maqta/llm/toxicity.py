"""Toxicity with noisy-channel deobfuscation.

Restoring.  A token that may hide a word (digits or marks among letters, letters of look-alike
scripts, one letter three times or more, or letters set apart by blanks or marks) becomes a lattice of
readings for each character.  Viterbi decoding under a character trigram model finds the
likeliest reading.  Any other token has one reading only and stays as it is.

Scoring.  A logistic model over words and word beginnings of the restored text.

The character model counts the plain words of the whole corpus.  The logistic model is fitted on a
bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.llm.common import table, tidy
from maqta.llm.letters import CLASSES, GRAMS, class_table, trigrams

#: Labelled rows that the model is fitted on, at most, and features it may have.
SAMPLE = 12_000
FEATURES = 1500
#: Likelihood ratio that a feature has at least: far above chance for a hundred thousand tried.
LEAST_RATIO = 24.0
THRESHOLD = 0.3
SEED = 8
CACHE = 200_000

# What a character may stand for besides itself.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c", "*": "", "%": "", "#": "", "&": "",
}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕјԁһкмтнвгαεοριτυνκ", "aeopcyxisjdhkmthbraeopituvk")
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
ENDS = ".,;:!?\"'()[]{}*#$%&<>|/\\-_~`^+=@…«»“”‘’"
#: Letters set apart: three or more single characters with one blank or mark between each two.
SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*~/|,][^\W_]){2,}(?![^\s.,;:!?])")
REPEATED = re.compile(r"([^\W\d_])\1\1+")
MIXED = re.compile(r"[^\W\d_][^\s]*[0-9@$!|+(<€£¢*%#&][^\s]*|[0-9@$!|+(<€£¢][^\s]*[^\W\d_]")

#: Log-probabilities of the channel: a character read as another, a mark dropped, a repeat dropped, a blank dropped.
READ_AS, DROP_MARK, DROP_REPEAT, DROP_BLANK = -0.7, -0.7, -0.3, -0.4
#: Dropping a sign that may stand for a letter costs more.
DROP_SIGN = -4.0
KEEP_DIGIT, KEEP_BLANK = -3.0, -2.5


@dataclass
class CharModel:
    """Trigram log-probabilities over letter classes; class 0 is a word's end."""

    logp: np.ndarray
    known: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: np.ndarray) -> "CharModel":
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        pair = c.sum(0)
        back = (pair + 0.1) / (pair + 0.1).sum(1, keepdims=True)
        total = c.sum(2, keepdims=True)
        return cls(np.log((c + 5 * back[None]) / (total + 5)).astype(np.float32))

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest string through a lattice; a state is the last two classes."""
        table_, logp = class_table(), self.logp
        beam: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in [*lattice, [(" ", 0.0)]]:
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in beam.items():
                for piece, cost in options:
                    s, x, y = score + cost, a, b
                    for ch in piece:
                        z = int(table_[min(ord(ch), len(table_) - 1)])
                        if z == 0 and y == 0:
                            continue
                        s, x, y = s + float(logp[x, y, z]), y, z
                    if (x, y) not in nxt or nxt[x, y][0] < s:
                        nxt[x, y] = (s, text + piece)
            beam = nxt
        return max(beam.values())[1].strip()

    def restore_token(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[token] = self.decode(lattice(token))
        return self.known[token]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each character: (letters, channel log-probability)."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        ch, j = token[i], i + 1
        while j < len(token) and token[j] == ch:
            j += 1
        run = j - i
        if ch in READINGS:
            reads = [(r * k, READ_AS) for r in READINGS[ch] for k in sorted({1, min(run, 2)})]
            reads.append((ch, KEEP_DIGIT) if ch.isdigit() else ("", DROP_SIGN if READINGS[ch] else DROP_MARK))
            out.append(reads)
        elif ch.isalpha():
            out.append([(ch, 0.0 if run == 1 else DROP_REPEAT)] + ([(ch * 2, 0.0 if run == 2 else DROP_REPEAT)] if run >= 2 else []))
        elif ch.isdigit():
            out.append([(ch * run, 0.0)])
        else:  # a blank or other mark between letters
            out.append([("", DROP_BLANK), (" ", KEEP_BLANK)])
        i = j
    return out


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b" .-_*~/|,\n\t")] = True
_SIGNS = re.compile("[0-9@$!|+(<€£¢*%#&]")


def _hints(t: str) -> tuple[bool, bool]:
    """Whether a text may hold letters set apart, and letters repeated, seen from its bytes, or its letters where bytes do not tell."""
    a = np.frombuffer(t.encode() if t.isascii() else t.encode("latin-1", "replace"), np.uint8)
    if len(a) < 5:
        return False, len(a) > 2
    same = a[1:] == a[:-1]
    repeated = bool((same[1:] & same[:-1] & (a[2:] >= 97)).any())
    if not repeated and not t.isascii() and max(t) > "ÿ":  # letters that have no byte of their own
        repeated = REPEATED.search(t) is not None
    sep = _SEPARATOR[a]
    spaced = bool((~sep[:-4] & sep[1:-3] & ~sep[2:-2] & sep[3:-1] & ~sep[4:] & np.concatenate([[True], sep[:-5]])).any())
    return spaced, repeated


def restore(text: str, model: CharModel) -> str:
    """The text in lower case with hidden words restored."""
    t = text.lower()
    if not t.isascii():
        t = INVISIBLE.sub("", unicodedata.normalize("NFKC", t)).lower()
        if any("Ͱ" <= c <= "ԯ" for c in t):
            t = " ".join(w.translate(LOOKALIKES) if any("Ͱ" <= c <= "ԯ" for c in w) and any("a" <= c <= "ÿ" for c in w) else w for w in t.split(" "))
    spaced, repeated = _hints(t)
    if spaced:
        t = SPACED.sub(lambda m: model.restore_token(m[0]), t)
    if not repeated and not _SIGNS.search(t):
        return t
    out = []
    for w in t.split():
        if w.isalpha() and not repeated:
            out.append(w)
            continue
        bare = w
        if not bare[-1].isalpha():
            tail = len(bare.rstrip(ENDS))
            # A tail of one or two signs may be letters; a longer or sentence-like one is an ending.
            bare = bare[:tail] if len(bare) - tail > 2 or bare[tail:].strip("$@!|+") else bare
        core = bare.lstrip(ENDS.replace("$", "").replace("@", "").replace("|", "").replace("(", ""))
        if core and not core.isalpha() and MIXED.fullmatch(core) and 3 * sum(c.isalpha() for c in core) >= len(core) and "://" not in core and ".com" not in core:
            plain = core.rstrip(ENDS)
            read = model.restore_token(core)
            out.append(read if read == plain or not plain.isalpha() else f"{read} {plain}")
        elif core and REPEATED.search(core):
            out.append(model.restore_token(core))
        else:
            out.append(w)
    return " ".join(out)


WORDS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words of a restored text and their first four, five and six letters."""
    words = set(WORDS.findall(text))
    out = {"=" + w for w in words}
    for n in (4, 5, 6):
        out.update(w[:n] for w in words if len(w) >= n)
    return out


@dataclass(frozen=True)
class Scorer:
    model: CharModel
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)  # features of words seen

    def score(self, text: str | None) -> float:
        found = 0.0
        if text:
            weights, known = self.weights, self.known
            if len(known) > 2 * CACHE:
                known.clear()
            keys: set[str] = set()
            for w in set(WORDS.findall(restore(text, self.model))):
                hits = known.get(w)
                if hits is None:
                    hits = known[w] = tuple(k for k in ("=" + w, w[:4], w[:5], w[:6]) if k in weights)
                if hits:
                    keys.update(hits)
            found = sum(weights[k] for k in sorted(keys))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, self.bias + found)))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts: summed per task, then by blocks of trigrams."""
    block = 1 << 13

    def run(batches):
        total = np.zeros(-(-GRAMS // block) * block, np.int64)
        some = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                text = "\n".join(x for x in batch.column(0).slice(lo, 512).to_pylist() if x)
                if text:
                    some = True
                    total += np.bincount(trigrams(text), minlength=len(total))
        n = len(total) // block if some else 0
        yield pa.record_batch([pa.array(range(n), pa.int32()), pa.array([total[i * block : (i + 1) * block].tobytes() for i in range(n)], pa.binary())], names=["block", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"block": group.column("block")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(tidy(run), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()  # GRAMS numbers in all
    out = np.zeros(-(-GRAMS // block) * block, np.int64)
    for r in found:
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.int64)
    return out[:GRAMS]


def fit(x: np.ndarray, y: np.ndarray, strength: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent."""
    n = len(y)
    weight = np.full(n, 1 / max(1, n), np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    wv, bv, step = w.copy(), b, 1.0 / (0.25 * max(1.0, float((x.sum(1) * weight).sum()) + 1) + strength / n)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ wv + bv)))
        g = weight * (p - y)
        w2, b2 = wv - step * (x.T @ g + strength / n * wv), bv - step * float(g.sum())
        m = k / (k + 3)
        wv, bv, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Scorer:
    """Character model of all texts, and a logistic model of at most ``sample`` labelled rows that are not held out.

    Where labels of a document differ the greatest holds.  Without labels of both kinds all scores are 0.
    """
    model = CharModel.of(char_counts(docs))
    chosen = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_toxic", "text")

    def run(batches):
        for batch in batches:
            found = [sorted(features(restore(t or "", model))) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "toxic", "found"])

    seen = rows.mapInArrow(tidy(run), "doc_id long, toxic int, found array<string>").persist()
    try:
        n, t = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not t or t == n:
            return Scorer(model, {}, -30.0)
        per = seen.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
        # Features that toxic documents have more often than chance allows, by likelihood ratio.
        part = lambda k, base: F.when(k > 0, k * F.log(k / F.col("n") / F.lit(base))).otherwise(0.0)
        ratio = 2 * (part(F.col("t"), t / n) + part(F.col("n") - F.col("t"), 1 - t / n))
        best = per.where(F.col("t") * n > F.col("n") * t).select("f", ratio.alias("ratio")).where(F.col("ratio") > LEAST_RATIO).orderBy(F.desc("ratio"), "f").limit(n_features).collect()
        names = [r["f"] for r in best]
        place = {f: i for i, f in enumerate(names)}

        def pick(batches):
            for batch in batches:
                yield pa.record_batch([batch.column(1), pa.array([[place[f] for f in fs if f in place] for fs in batch.column(2).to_pylist()], pa.list_(pa.int32()))], names=["toxic", "ids"])

        got = seen.mapInArrow(tidy(pick), "toxic int, ids array<int>").collect()  # the bounded sample
    finally:
        seen.unpersist()
    x, y = np.zeros((len(got), len(names)), np.float32), np.array([r["toxic"] for r in got], np.float32)
    for i, r in enumerate(got):
        x[i, r["ids"]] = 1
    w, b = fit(x, y)
    return Scorer(CharModel(model.logp), {f: float(v) for f, v in zip(names, w, strict=True)}, b)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, predicted of every row; null texts are empty and get the score of a text without features.

    Texts of any length are scored whole.  Repeated rows get equal scores, each its own row; a score of just ``THRESHOLD`` counts
    as toxic.  An empty table gives an empty result; columns besides doc_id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # GRAMS floats and at most FEATURES weights

    def run(batches):
        s = sent.value
        for batch in batches:
            found = np.array([s.score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
