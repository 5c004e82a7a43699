import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maqta.config import ChunkConfig
from maqta.functions import text as X
from maqta.functions import words
from maqta.operators import document, metrics, segments, sentences, structure, vectors
from maqta.operators.sentences import CHARACTERS, WORDS
from maqta.plans.chunker import Chunker

PARTS = [
    "# عنوان", "## ب ##", "**غامق**:", "المادة (3)", "(4) المادة", "الفصل الأول: عام", "مقدمة", "Summary:", "1.2 Some title", "1.2 Ends.", "#x", "* بند", "- item", "(أ) نص",
    "أولاً نص", "12) one", "قال د. أحمد", "عام 1445 هـ.", "عام هـ. ثم", "etc. and", "etc. More", "U.S.A. now", "é. Un", "². Un", "ـ. x", "3. two", "see 3. two", "...", "... x", "?!» نعم", "fin.ثم", "a.b@c.d e",
    "كلمة " * 30, "x y; z، w " * 12, "ثم نص " * 20, "😀 one. 😀", " ", "\r\n", "\r", "\x0b", "\x85", "\n", "\n \n", "\n\n\n", " ", "\xa0", "  \n", "oui.\n", "non\n", "Dr.", "no. 5", "ص. 3", "ف.", "(م.)", "%%% a.%%%", "İ ıK ſ.", "𝐀. 𝟏𝟐. x",
]


def odd_texts(n: int = 250) -> list[str]:
    rng = random.Random(11)
    return [rng.choice(["", " "]).join(rng.choice(PARTS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("structure_too", [False, True])
def test_units_of_a_text_are_those_of_the_columns(spark, structure_too):
    texts, want = odd_texts(), {}
    for length, most in ((WORDS, 10), (CHARACTERS, 40)):
        rows = sentences.units(frame(spark, texts), most, structure_too, length)
        path = structure.sections(frame(spark, texts), structure_too).select("doc_id", "section_idx", "headings")
        want = {}
        for r in rows.join(path, ["doc_id", "section_idx"]).orderBy("doc_id", "unit_idx").collect():
            want.setdefault(r["doc_id"], []).append((r["section_idx"], r["start"], r["end"], r["text"], r["paragraph_start"], r["tokens"], r["headings"]))
        found = document.Sentences()
        for k, text in enumerate(texts):
            got = found.units(text, most, structure_too, length)
            assert [tuple(u) for u in got] == want.get(k, [])
            assert all(text[u.start : u.end] == u.text for u in got)


def test_stems_and_openings_are_those_of_the_columns(spark):
    rng = random.Random(5)
    letters = "والفبكسليتنهمات" + "أإىةـً١ab3éK"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(6)) for _ in range(400)]
    texts += [f"{p}{e} x" for p in ("اما", "لذلك", "على سبيل المثال", "However", "من جهة أخرى", "كما ان") for e in ("", ",", "،", "ب")] + odd_texts(100)
    rows = frame(spark, texts).select("doc_id", X.stems("text").alias("s"), X.discourse_bias("text").alias("b")).orderBy("doc_id").collect()
    runs = words.Runs()
    for r, t in zip(rows, texts, strict=True):
        assert (runs.stems_of(t), runs.discourse_bias(t, 1.0)) == (r["s"], r["b"])


@pytest.mark.parametrize("ngrams", [(2, 4), (1, 3), (3, 6)])
def test_features_are_those_of_the_columns(spark, ngrams):
    texts = [*odd_texts(60), "aaaa aaa aaaaa. aaaa", "من إلى", "a_b ab. من إلى!", "ة é x"]
    embedder, config = vectors.HashingEmbedder(ngram_range=ngrams), ChunkConfig(respect_structure=False, max_tokens=49)
    units = sentences.units(frame(spark, texts), 49, False)
    feats = vectors.features(units.select("doc_id", "unit_idx", "text"), embedder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("t"))
    want = {r["doc_id"]: (r["n"], r["t"]) for r in feats.collect()}
    assert {r["doc_id"]: (r["n_features"], r["total_tf"]) for r in segments.feature_counts(frame(spark, texts), config, embedder).collect()} == want
    native = {}
    for r in vectors.hashed_vectors(units.select("doc_id", "unit_idx", "text"), embedder).collect():
        native.setdefault(r["doc_id"], {}).setdefault(r["unit_idx"], {})[r["bucket"]] = r["w"]
    rows = list(embedder.rows([u.text for u in document.Sentences().units(t, 49, False, WORDS)] for t in texts))
    for k, m in enumerate(rows):
        dense = np.zeros((len(m), embedder.dim))
        for i, places in native.get(k, {}).items():
            dense[i, list(places)] = list(places.values())
        assert np.abs(dense - m).max(initial=0) < 1e-9


def test_what_is_forgotten_is_learnt_again(monkeypatch):
    texts = [[" ".join(f"كلمة{i * k}" for i in range(9)), "و ف", "the"] for k in range(40)]
    want = list(vectors.HashingEmbedder().rows(texts))
    monkeypatch.setattr(vectors, "KNOWN_STEMS", 20)
    monkeypatch.setattr(vectors, "CELLS", 16)
    vectors._known.cache_clear()
    for a, b in zip(vectors.HashingEmbedder().rows(texts), want, strict=True):
        assert np.allclose(a, b, atol=1e-12)


def test_cuts_one_by_one_are_those_of_arrays(monkeypatch):
    rng = random.Random(8)
    runs = [([rng.choice([0, 1, 2, 9]) for _ in range(n)], [rng.choice([-1.0, 0.0, 0.5]) for _ in range(n - 1)]) for n in (2, 5, 30, 60) for _ in range(40)]
    cuts = [segments.optimal_cuts(np.array(t), np.array(g), 4, 12, 100.0) for t, g in runs]
    monkeypatch.setattr(segments, "FEW", 0)
    assert cuts == [segments.optimal_cuts(np.array(t), np.array(g), 4, 12, 100.0) for t, g in runs]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("settings", [{}, {"strategy": "greedy"}, {"overlap_sentences": 2}, {"respect_structure": False}])
def test_chunks_take_one_pass_over_texts(spark, settings):
    for df in (Chunker(**settings).chunk(frame(spark, ["x"])), Chunker(**settings).chunk_hierarchical(frame(spark, ["x"]))):
        plan = _plan(df)
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan


def test_scores_and_features_take_one_pass_over_texts(spark):
    for df in (segments.gap_scores(frame(spark, ["x"]), ChunkConfig()), segments.feature_counts(frame(spark, ["x"]), ChunkConfig())):
        plan = _plan(df)
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan


def test_quality_chunks_once(spark):
    df = metrics.chunk_quality(Chunker(respect_structure=False).chunk(frame(spark, ["x"])))
    assert _plan(df).count("MapInArrow") == 2 and "Join" not in _plan(df)


def test_sparse_rows_give_the_distances_and_lengths_of_dense_ones():
    texts = [t for t in odd_texts(80) if t] + ["one. two, one.\n\n" * 40, "... !!", "a.b,c", "İ. ΑΣ.Α x"]
    embedder, found = vectors.HashingEmbedder(), document.Sentences()
    docs = [d for d in (found.units(t, 8, True, WORDS) for t in texts) if d]
    sparse = list(embedder.sparse_rows([u.text for u in d] for d in docs))
    for d, rows in zip(docs, sparse, strict=True):
        tokens = words.Runs()
        dense, sections = embedder._matrix([tokens.tokens(u.text) for u in d]), np.array([u.section_idx for u in d])
        assert np.abs(rows.dense() - dense).max() < 1e-12
        for window in (1, 2, 3, 5):
            want = np.array(vectors.context_distance(dense, sections, window), np.float64)
            assert np.allclose(rows.distances(sections, window), want, atol=1e-12, equal_nan=True)
        starts = list(range(0, len(d), 3))
        assert np.allclose(segments.coherence(rows, starts), segments.coherence(dense, starts), atol=1e-12)


def test_runs_of_many_texts_are_stemmed_as_one_by_one():
    runs = [r for t in [*odd_texts(150), "كتابًا, كتابًا.ب 3عام عام3 ﷺ"] for r in t.split()]
    assert words.tagged(runs) == [words.tagged([r])[0] for r in runs]
    assert words.tagged(["a.b,c"])[0] == ["=a", "=b", "=c"]


def test_cuts_with_many_candidates_are_those_of_arrays(monkeypatch):
    rng = random.Random(9)
    runs = [([rng.choice([0, 1, 1, 2, 30]) for _ in range(n)], [rng.choice([-1.0, 0.0, 0.25, 0.5]) for _ in range(n - 1)]) for n in (70, 200) for _ in range(30)]
    cut = lambda: [segments.optimal_cuts(np.array(t), np.array(g), 16, 150, 100.0) for t, g in runs]
    found = cut()
    monkeypatch.setattr(segments, "FEW", 0)
    assert found == cut()


def test_percentiles_are_those_of_numpy():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 77):
        own = rng.random(n).round(3)
        assert segments._percentiles(own, 0, 25, 50, 75, 85, 95, 100) == np.percentile(own, [0, 25, 50, 75, 85, 95, 100]).tolist()


def test_grams_of_short_letters_are_looked_up_without_names():
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x621, 0x64B)]
    stems = ["=" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    known = vectors.Vocabulary(vectors.HashingEmbedder())
    known.of_tokens([stems])
    assert not known.names and known.known > 1000
    # Letters beyond those that have a number, and words that are stems elsewhere, have the features of their names too.
    many = ["=" + "".join(chr(rng.randrange(0x410, 0x590)) for _ in range(5)) for _ in range(200)]
    many += ["=" + "a" * k for k in range(1, 6)] + [p + w for w in ("ab", "ba") for p in rng.sample("=~", 2)] + ["=wide一", "~new"]
    for group in (stems, many, stems):
        numbers, ends = known.of_tokens([[t] for t in group])
        unit, feature, times = known.counted(numbers, ends)
        for k, token in enumerate(group):
            word = token[1:]
            want = {"w:" + word: 1.0 if token[0] == "~" else 2.0}
            for i in range(len(word) + 2) if token[0] == "=" else ():
                for n in (2, 3, 4):
                    if i + n <= len(word) + 2:
                        name = "c:" + f" {word} "[i : i + n]
                        want[name] = want.get(name, 0.0) + 1.0
            own = unit == k
            assert len(feature[own]) == len(want)
            sums = {name: zlib.crc32(name.encode()) for name in want}
            got = sorted(zip(known.bucket[feature[own]].tolist(), known.sign[feature[own]].tolist(), times[own].tolist(), strict=True))
            assert got == sorted((s % 2048, 1.0 if s >> 31 else -1.0, want[name]) for name, s in sums.items())


def test_words_of_units_are_counted_together():
    found = document.Sentences()
    for text in odd_texts(60):
        spans = [(u.start, u.end) for u in found.units(text, 10**6, False, CHARACTERS)]
        inside = np.array([bool(sentences._WORDS.match(c)) for c in text], bool)
        assert not spans or document._words_within(inside, *map(list, zip(*spans, strict=True))) == [WORDS.of(text[a:b]) for a, b in spans]
