import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maqta.config import ChunkConfig
from maqta.functions import lexicon as L
from maqta.functions import udtf
from maqta.operators import benchmark, metrics, segments, vectors
from maqta.operators.sentences import CHARACTERS, Length
from maqta.operators.vectors import CallableEmbedder, HashingEmbedder, MemoisingEmbedder
from maqta.plans.chunker import Chunker, children, children_of
from maqta.sources import files
from maqta.streaming import chunks as stream

WEATHER = ["تهطل الأمطار الغزيرة على الساحل هذا المساء.", "الأمطار الغزيرة ترفع منسوب مياه السواحل.", "الرياح الشديدة ترافق الأمطار والغيوم على الساحل.", "الغيوم الكثيفة تحمل الأمطار نحو الساحل.", "تتراجع الأمطار والرياح والغيوم غداً."]
FOOTBALL = ["فاز الفريق بمباراة كرة القدم أمس.", "سجل لاعب الفريق هدفين في المباراة.", "حارس مرمى الفريق أنقذ هدفاً في المباراة.", "جمهور الفريق احتفل بهدف اللاعب في الملعب.", "يلعب الفريق مباراة أخرى في الملعب الجديد."]
TOPICS = " ".join(WEATHER + FOOTBALL)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def chunk(spark, text, **settings):
    rows = Chunker(**settings).chunk(frame(spark, [text])).orderBy("index").collect()
    for r in rows:
        assert text[r["start"] : r["end"]] == r["text"]
    assert [r["index"] for r in rows] == list(range(len(rows)))
    return rows


def test_a_change_of_topic_is_found(spark):
    rows = chunk(spark, TOPICS, max_tokens=45, min_tokens=15, respect_structure=False)
    assert [r["text"][:8] for r in rows] == [WEATHER[0][:8], FOOTBALL[0][:8]]
    assert rows[0]["boundary_score"] is None and rows[1]["boundary_score"] > 0


def test_greedy_keeps_the_budget(spark):
    rows = chunk(spark, TOPICS, max_tokens=20, min_tokens=5, strategy="greedy", respect_structure=False)
    assert len(rows) >= 3 and all(r["token_count"] <= 20 for r in rows)


def test_overlap_stays_in_the_section(spark):
    rows = chunk(spark, TOPICS, max_tokens=45, min_tokens=15, overlap_sentences=1, respect_structure=False)
    assert rows[1]["text"].startswith(WEATHER[-1]) and rows[1]["metadata"]["overlap_sentences"] == 1
    assert rows[1]["metadata"]["core_start"] == TOPICS.index(FOOTBALL[0])
    assert rows[1]["sentence_count"] == 6
    two = chunk(spark, f"# أ\n{WEATHER[0]}\n# ب\n{FOOTBALL[0]}\n", overlap_sentences=3)
    assert [r["metadata"]["overlap_sentences"] for r in two] == [0, 0]
    assert two[0]["contextual_text"] == f"أ\n\n{WEATHER[0]}"


def test_hierarchy(spark):
    tiers = Chunker(max_tokens=20, min_tokens=5, respect_structure=False).chunk_hierarchical(frame(spark, [TOPICS]), 45, 15).persist()
    parents = {r["index"]: r for r in tiers.where("tier = 'parent'").collect()}
    kids = tiers.where("tier = 'chunk'").orderBy("index").collect()
    assert len(parents) == 2 and len(kids) > 2
    for k in kids:
        p = parents[k["parent_id"]]
        assert p["start"] <= k["metadata"]["core_start"] and k["end"] <= p["end"]
    assert children_of(tiers, 0, 1).count() == sum(k["parent_id"] == 1 for k in kids)
    assert children(tiers).count() == len(kids)


def test_words_are_counted_once(spark):
    """A chunk's words are its units' words: no second count of its text, and the same number."""
    long = " ".join(f"كلمة{i}، a_{i}.b{i}؛ 3.14 و.ب" for i in range(60))
    for overlap in (0, 2):
        out = Chunker(max_tokens=20, min_tokens=5, overlap_sentences=overlap).chunk(frame(spark, [f"# أ\n{TOPICS}\n{long}.كلمة\nabc.def!؟ghi…ا", long, ""]))
        assert "regexp_count" not in out._jdf.queryExecution().toString()
        rows = out.withColumn("again", F.regexp_count("text", F.lit(L.WORD))).collect()
        assert len(rows) > 20 and all(r["token_count"] == r["again"] for r in rows)


def test_length_functions(spark):
    text = "؛ ".join(["كلمة أولى، كلمة ثانية"] * 6) + " " + "ط" * 50 + "."
    for length in (len, CHARACTERS, lambda t: 3 * len(t.split()) ** 2):
        of = length.of if isinstance(length, Length) else length
        rows = chunk(spark, text, max_tokens=48, min_tokens=5, length_function=length, respect_structure=False)
        assert len(rows) > 3 and all(r["token_count"] == of(r["text"]) for r in rows)
        assert all(r["token_count"] <= 48 or " " not in r["text"] for r in rows)
    assert [r["start"] for r in chunk(spark, text, max_tokens=48, min_tokens=5, length_function=len)] == [r["start"] for r in chunk(spark, text, max_tokens=48, min_tokens=5, length_function=CHARACTERS)]


def test_one_scan_and_two_exchanges(spark, tmp_path):
    frame(spark, [TOPICS]).write.parquet(str(tmp_path / "d"))
    df = Chunker(max_tokens=45, min_tokens=15).chunk(spark.read.parquet(str(tmp_path / "d")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2
    assert plan.count("FileScan") == 1


def test_memoising_embedder_gives_a_text_one_vector():
    calls = []
    made = MemoisingEmbedder(CallableEmbedder(lambda texts: calls.append(list(texts)) or [[len(t), 1.0] for t in texts]))
    a, b = made.rows([["x", "yy", "x"], ["yy", "zzz"]])
    assert (a[0] == a[2]).all() and (a[1] == b[0]).all() and calls == [["x", "yy"], ["zzz"]]
    one, two = MemoisingEmbedder(HashingEmbedder()).rows([["طقس", "مطر طقس"], ["طقس"]])
    assert (one[0] == two[0]).all()


def test_edges(spark):
    rows = Chunker().chunk(frame(spark, ["", None, " \n ", "جملة واحدة."])).collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(3, "جملة واحدة.")]
    assert Chunker().chunk(frame(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("bad", [{"min_tokens": 256}, {"strategy": "magic"}, {"threshold_type": "magic"}, {"parent_max_tokens": 100}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        ChunkConfig(**bad)


@pytest.mark.parametrize("kind", ["percentile", "std", "iqr"])
def test_thresholds(kind):
    own = np.array([0.3, 0.9, 0.5, 0.7, 0.1])
    got = segments.threshold(own, ChunkConfig(threshold_type=kind, threshold_amount=None if kind != "iqr" else 1.5))
    mean = sum(own) / 5
    std = (sum((x - mean) ** 2 for x in own) / 5) ** 0.5
    want = {"percentile": 0.5 + 0.8 * 0.2, "std": mean + 0.5 * std, "iqr": 0.7 + 1.5 * 0.4}[kind]
    assert got == (pytest.approx(want), pytest.approx(std))
    assert segments.threshold(own[:0], ChunkConfig()) == (0.0, 1.0) and segments.threshold(own[:1], ChunkConfig())[1] == 1.0


def test_greedy_cuts_follow_their_definition():
    rng = random.Random(6)
    for _ in range(500):
        n = rng.randint(1, 12)
        tokens, scores = np.array([rng.randint(0, 9) for _ in range(n)]), np.array([rng.uniform(-1, 1) if rng.random() < 0.9 else np.nan for _ in range(n - 1)])
        least, most, theta = 5, 12, 0.2
        cuts = segments.greedy_cuts(tokens, scores, theta, least, most)
        edges = [0, *cuts, n]
        for a, b in itertools.pairwise(edges):
            assert b > a and (tokens[a:b].sum() <= most or tokens[a : b - 1].sum() <= most and b - a == 1)
            for k in range(a + 1, b):  # no earlier cut was due
                assert not (tokens[a:k].sum() >= least and scores[k - 1] > theta)
            if b < n:  # and this one was
                assert tokens[a : b + 1].sum() > most or (tokens[a:b].sum() >= least and scores[b - 1] > theta)


def test_optimal_cuts_match_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(2, 9)
        tokens, gains = np.array([rng.randint(1, 9) for _ in range(n)]), np.array([rng.uniform(-1, 1) for _ in range(n - 1)])
        least, most = 4, 12
        best = None
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, n), k) for k in range(n)):
            edges = [0, *cuts, n]
            sizes = [int(tokens[a:b].sum()) for a, b in itertools.pairwise(edges)]
            if any(s > most and b - a > 1 for s, (a, b) in zip(sizes, itertools.pairwise(edges), strict=True)):
                continue
            value = sum(gains[c - 1] for c in cuts) - sum(100 * (least - s) / least for s in sizes if s < least)
            if best is None or value > best[0] + 1e-9:
                best = value, list(cuts)
        assert segments.optimal_cuts(tokens, gains, least, most, 100.0) == best[1]


def test_ties_take_the_shortest_last_piece():
    assert segments.optimal_cuts(np.array([2, 2, 2]), np.zeros(2), 1, 4, 100.0) == [1, 2]


def test_hashing_forms_agree(spark):
    units = spark.createDataFrame([(0, i, 0, i, s) for i, s in enumerate([*WEATHER, "من إلى", "the law and Law"])], "doc_id long, unit_idx int, section_idx int, start int, text string")
    native = {}
    for r in vectors.hashed_vectors(units).collect():
        native.setdefault(r["unit_idx"], {})[r["bucket"]] = r["w"]
    for r in vectors.gap_distances(units).collect():
        at, w = vectors.unpack_row(bytes(r["vector"]))
        assert {k: v for k, v in native[r["unit_idx"]].items() if abs(v) > 1e-12} == pytest.approx(dict(zip(at.tolist(), w.tolist(), strict=True)))
        assert np.linalg.norm(w) == pytest.approx(1)


def test_context_distance_is_cosine_of_means():
    rng = np.random.default_rng(1)
    v, sec = rng.normal(size=(9, 5)), np.array([0, 0, 0, 0, 1, 1, 1, 2, 2])
    found = vectors.context_distance(v, sec, 3)
    for i in range(8):
        if sec[i] != sec[i + 1]:
            assert found[i] is None
            continue
        left = v[[k for k in range(max(0, i - 2), i + 1) if sec[k] == sec[i]]].mean(0)
        right = v[[k for k in range(i + 1, min(9, i + 4)) if sec[k] == sec[i]]].mean(0)
        assert found[i] == pytest.approx(1 - left @ right / np.linalg.norm(left) / np.linalg.norm(right))


def test_callable_embedder(spark):
    made = CallableEmbedder(lambda texts: [[len(t), t.count("ا") + 1] for t in texts])
    assert chunk(spark, TOPICS, embedder=made, max_tokens=20, min_tokens=5, respect_structure=False)


def test_idf_needs_two_units(spark):
    one = HashingEmbedder()._matrix([["=طقس"]], {})
    assert np.linalg.norm(one) == pytest.approx(1) and not HashingEmbedder()._matrix([[]], {}).any()


def test_metrics(spark):
    rows = spark.createDataFrame([([5], [5], 10), ([5], [2], 10), ([5], [2, 5, 8], 10), ([], [], 1), ([3], [3], 0)], "g array<int>, p array<int>, n int").coalesce(1)
    g, p, n = F.col("g"), F.col("p"), F.col("n")
    found = rows.select(metrics.pk(g, p, n).alias("pk"), metrics.window_diff(g, p, n).alias("wd")).collect()
    assert found[0]["pk"] == found[0]["wd"] == 0 and found[1]["pk"] > 0 and found[2]["wd"] > 0
    assert found[3]["pk"] == found[4]["pk"] == 0


def test_metrics_match_plain_python(spark):
    rng, rows = random.Random(4), []
    for _ in range(60):
        n = rng.randint(1, 25)
        rows.append((sorted(rng.sample(range(n + 2), min(n, rng.randint(0, 5)))), sorted(rng.sample(range(n + 2), min(n, rng.randint(0, 5)))), n))
    df = spark.createDataFrame(rows, "g array<int>, p array<int>, n int").coalesce(1)
    found = df.select(metrics.pk(F.col("g"), F.col("p"), F.col("n")).alias("pk"), metrics.window_diff(F.col("g"), F.col("p"), F.col("n")).alias("wd")).collect()
    for (g, p, n), r in zip(rows, found, strict=True):
        a, b = ([int(i in x) for i in range(1, n)] for x in (g, p))
        k = max(2, round(n / (1 + sum(a)) / 2))
        pairs = [(sum(a[i : i + k]), sum(b[i : i + k])) for i in range(n - k)]
        assert r["pk"] == pytest.approx(sum((x > 0) != (y > 0) for x, y in pairs) / len(pairs) if pairs else 0)
        assert r["wd"] == pytest.approx(sum(x != y for x, y in pairs) / len(pairs) if pairs else 0)


def test_quality(spark):
    chunks = Chunker(max_tokens=45, min_tokens=15, respect_structure=False).chunk(frame(spark, [TOPICS]))
    r = metrics.chunk_quality(chunks).first()
    assert r["chunks"] == 2 and 0 < r["mean_coherence"] <= 1 and -1 <= r["mean_adjacent_similarity"] <= 1
    words = [len(t.split()) for t in (" ".join(WEATHER), " ".join(FOOTBALL))]
    assert (r["min_words"], r["max_words"], r["mean_words"]) == (min(words), max(words), sum(words) / 2)


def test_benchmark_report(spark):
    topics = {"w": WEATHER + WEATHER[:2], "f": FOOTBALL + FOOTBALL[:2], "x": [f"كلمة{i} رقم{i} نص{i} حرف{i}." for i in range(7)]}
    docs = benchmark.topic_documents(spark, topics, 6, seed=1, paragraphs=True)
    out = {r["method"]: r for r in benchmark.report(docs, {"fixed": lambda d: benchmark.fixed_size(d, 40), "optimal": benchmark.semantic(Chunker(max_tokens=60, min_tokens=10, respect_structure=False))}).collect()}
    assert out["optimal"]["pk"] < out["fixed"]["pk"]


def test_fixed_size(spark):
    parts = ["...", "aa bb cc dd ee.", "ff gg.", "hh ii.", "jj kk ll mm nn.", "oo."]
    text, at = " ".join(parts), []
    for p in parts:
        at.append(sum(len(x) + 1 for x in parts[: len(at)]))
    # A part without a word opens nothing; one over the budget stands alone.
    assert benchmark.fixed_size(frame(spark, [text]), 4).first()["cuts"] == [at[2], at[4], at[5]]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# x\r\none two.\r\n".encode())
    docs = files.read_text(spark, str(tmp_path / "a.md"))
    assert docs.first()["text"] == "# x\none two.\n"
    chunks = Chunker().chunk(docs)
    assert '"headings" : [ "x" ]' in files.json_array(chunks).first()["json"]
    assert '"parent_id":null' in files.as_dict(chunks).first()["json"]
    assert "one two." in files.as_text(chunks).first()["line"]
    files.write_jsonl(chunks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert '"children"' in files.hierarchical_json(Chunker().chunk_hierarchical(docs)).first()["json"]


def test_stream_equals_batch(spark, tmp_path):
    frame(spark, [TOPICS, "واحد."]).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    chunker = Chunker(max_tokens=45, min_tokens=15, respect_structure=False)
    stream.chunk_stream(source, chunker, stream.parquet_sink(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_table_function(spark):
    udtf.register(spark, "halves", lambda t: [(0, len(t) // 2), (len(t) // 2, len(t))])
    assert [r["piece"] for r in spark.sql("SELECT piece FROM VALUES ('abcd') v(t), LATERAL halves(t)").collect()] == ["ab", "cd"]


def test_command_line(spark, tmp_path, capsys):
    from maqta import cli

    path = tmp_path / "a.md"
    path.write_text("# مقدمة\nجملة أولى. جملة ثانية.\n", encoding="utf-8")
    assert cli.main([str(path), "--format", "json", "--stats"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)[0]["token_count"] == 4 and json.loads(said.err)["chunks"] == 1
    assert cli.main([str(path), "--hierarchical", "512"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert len(found["parents"]) == 1 and found["children"][0]["parent_id"] == 0
    assert cli.main([str(path)]) == 0
    assert capsys.readouterr().out == "── chunk 0 · 4 tokens · مقدمة ──\nجملة أولى. جملة ثانية.\n\n"
    path.write_text(" \n", encoding="utf-8")
    assert cli.main([str(path), "--hierarchical", "512", "--stats"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out) == {"parents": [], "children": []} and json.loads(said.err) == {"chunks": 0}


def test_public_names():
    import maqta

    assert all(getattr(maqta, name) is not None for name in maqta.__all__)
    with pytest.raises(AttributeError):
        maqta.no_such_name
