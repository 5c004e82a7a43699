"""Language ID, toxicity, mixing, line dedup and packing on small tables."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maqta.llm import langid, line_dedup, mixing, packing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = ["the house and the garden of the king", "this is the way that we went to the river", "there was nothing in the window"]
DE = ["das haus und der garten des königs", "dies ist der weg den wir zum fluss gingen", "es war nichts in dem fenster zu sehen"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        lang, pool = ("en", EN) if i % 2 else ("de", DE)
        rows.append((i, " ".join(rng.choice(pool) for _ in range(6)), lang, f"s{i % 3}"))
    return docs(spark, rows + [(900, None, "en", None), (901, "", None, "s0"), (902, "12 34 !!", "de", "s1"), (903, "the garden", None, None)])


def test_language_id_held_out(corpus):
    out = langid.predict(corpus, langid.learn(corpus), keep=True).where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("doc_id") < 900))
    rows = out.collect()
    assert len(rows) > 30 and all(r["lang_pred"] == r["lang"] for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_odd_rows(spark, corpus):
    model = langid.learn(corpus)
    found = {r["doc_id"]: r for r in langid.predict(corpus.where("doc_id >= 900"), model).collect()}
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and found[903]["lang_pred"] == "en"
    none = langid.learn(corpus.limit(0))
    assert none.names == () and langid.predict(corpus.limit(0), none).count() == 0
    clash = corpus.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    assert langid.predict(clash, model, keep=True).where("doc_id = 903").first()["lang_pred"] == "en"
    long = docs(spark, [(1, "the garden of the king " * 20000, None, None)])
    assert langid.predict(long, model).first()["lang_pred"] == "en"


def test_profiles_bind_and_bundle_letters():
    def vector(ch):
        return langid.letter_vectors(np.array([0 if ch == " " else ord(ch)]))[0].astype(int)

    for text in ("abca", "été abc été", "كتاب ab كتاب", "中文字", "a" * 40):
        marked, total = f" {text} ", np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(marked, marked[1:], marked[2:]):
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        assert (langid.bundle(text.upper()) == total).all()
    assert langid.bundle("12 !") is None and langid.bundle("") is None
    points = np.array([ord(c) for c in "abcكتبвгд中文字"])
    v = langid.letter_vectors(points).astype(int)
    assert abs(v @ v.T / langid.DIMENSIONS - np.eye(len(points))).max() < 0.25  # no two letters are alike


def test_predictions_are_the_greatest_cosines(spark, corpus):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in corpus.collect()]
    learned = {r["doc_id"] for r in corpus.where(~langid.held_out(F.col("doc_id"))).collect()}
    totals = {}
    for i, t, lang in rows:
        if i in learned and lang is not None and langid.profile(t) is not None:
            totals[lang] = totals.get(lang, 0) + langid.profile(t)
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.predict(corpus, langid.learn(corpus)).collect()}
    want = set()
    for i, t, _ in rows:
        v = langid.profile(t)
        cos = sorted(((float(v @ p / np.linalg.norm(p)), k) for k, p in totals.items()), reverse=True) if v is not None else [(0.0, "und")]
        want.add((i, cos[0][1], round(min(1.0, max(0.0, cos[0][0])), 9)))
    assert got == want


def test_mixing_meets_targets(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "a", "b", "c", None])
        rows.append((i, " ".join(["w"] * rng.randint(1, 40)), "en", source))
    out = mixing.mix(docs(spark, rows + [(500, None, None, "a"), (501, "", None, "empty")])).collect()
    size, taken, target = {}, {}, {}
    source_of = {i: s for i, _, _, s in rows} | {500: "a", 501: "empty"}
    for r in out:
        s = source_of[r["doc_id"]]
        size[s], taken[s], target[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len((next((t for i, t, _, _ in rows if i == r["doc_id"]), "") or "").split())
    names = sorted(x for x in size if x) + [None]
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    want, open_ = {n: 0.0 for n in names}, set(names)
    left = sum(size.values())
    while True:
        share = {n: left * weight[n] / sum(weight[k] for k in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * size[n]}
        if not over:
            want |= share
            break
        for n in over:
            want[n] = 3 * size[n]
            left -= want[n]
        open_ -= over
    for n in names:
        assert target[n] == pytest.approx(want[n]) and abs(taken[n] - want[n]) <= 1


def test_mixing_is_stable_and_takes_empty_tables(spark, corpus):
    assert sorted(mixing.mix(corpus).collect()) == sorted(mixing.mix(corpus.repartition(7)).collect())
    assert mixing.mix(corpus.limit(0)).count() == 0
    whole = mixing.mixed_documents(corpus.unionByName(corpus))
    assert whole.columns == corpus.columns and whole.where("text is null").count() == 0


@pytest.mark.parametrize("doc_id, n", [(7, 100), (None, 1000)])
@pytest.mark.parametrize("most", [10_000, 5])
def test_mixing_meets_targets_where_rows_tie(spark, monkeypatch, doc_id, n, most):
    monkeypatch.setattr(mixing, "SORTED", most)
    rows = [(doc_id, "ten words " * 5, "en", "a")] * n + [(i, "w " * 20, "en", "b") for i in range(4 * n)]
    df = docs(spark, rows).repartition(5)
    got = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in got) == 5 * n and all(abs(r["taken"] - r["target"]) <= 1 for r in got)
    whole = mixing.mixed_documents(df.withColumn("size", F.lit("clash"))).groupBy("source").count().collect()
    sizes = {"a": 10, "b": 20}
    targets = {"a": 90 * n / 3, "b": 2 * 90 * n / 3}
    assert all(abs(r["count"] * sizes[r["source"]] - min(targets[r["source"]], 3 * sizes[r["source"]] * (n if r["source"] == "a" else 4 * n))) <= sizes[r["source"]] for r in whole)


def test_hosts_of_urls(spark):
    urls = {"http://www.A.org/x?y": "a.org", "https://u:p@b.example.com:8080#t": "b.example.com", "ftp://[::1]:21/": "[::1]", "no url": None, "http:///x": None, None: None, "http://c.org.": "c.org"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", line_dedup.host_of(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in got} == urls


def test_lines_of_pages_go_by_the_ratio_of_their_host_alone(spark):
    rows = [(i, f"http://{'www.' if i % 2 else ''}Big.org/{i}", f"own {i}\nmenu\n" + ("rare" if i < 2 else f"other {i}")) for i in range(40)]
    rows += [(100, "http://two.org/a", "menu\nx"), (101, "http://two.org/b", "menu\ny"), (102, "http://one.org/", "menu\nmenu"), (103, None, "menu\nz"), (104, None, "menu")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["html"] for r in line_dedup.dedup_lines(pages, line_dedup.host_of(F.col("url")), "html").collect()}
    assert got[0] == "own 0\nrare" and got[39] == "own 39\nother 39"  # 2 of 40 pages are not more than 5 in 100
    assert (got[100], got[101], got[102], got[103], got[104]) == ("x", "y", "menu\nmenu", "z", "")


def test_keys_follow_quality(spark):
    rows = [(i, "word word" if i % 2 else "#### 1234", "en", "s") for i in range(2000)]
    k = mixing.keyed(docs(spark, rows))
    means = dict(docs(spark, rows).select("text", k["key"].alias("k")).groupBy("text").agg(F.avg("k")).collect())
    assert means["word word"] == pytest.approx(1 / 1.0, rel=0.15) and means["#### 1234"] > 3


def test_line_dedup_by_host(spark):
    rows = [(i, f"own line {i}\nmenu\n\nshared by few" if i < 3 else f"own line {i}\nmenu\n", "en", "big") for i in range(100)]
    rows += [(200, "menu\nx", "en", "small"), (201, None, "en", "small"), (202, "", "en", None), (203, "menu\nmenu", "en", "big"), (203, "menu\nmenu", "en", "big")]
    out = line_dedup.dedup_lines(docs(spark, rows).withColumn("n_dropped", F.lit("clash"))).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["text"] == "own line 0\n\nshared by few" and by[0][0]["n_dropped"] == 1 and by[0][0]["n_lines"] == 4
    assert by[200][0]["text"] == "menu\nx" and by[201][0]["text"] is None and by[201][0]["n_lines"] == 0 and by[202][0]["text"] == ""
    assert [r["text"] for r in by[203]] == ["", ""] and len(out) == len(rows)
    assert line_dedup.dedup_lines(docs(spark, rows).limit(0)).count() == 0


def test_native_operators_stay_native(spark, corpus):
    for df in (mixing.mix(corpus), line_dedup.dedup_lines(corpus)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def brute_bins(lengths):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if sum(b) + n <= packing.CAPACITY]
        if fit:
            max(fit, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(sorted(b) for b in bins)


def test_best_fit_matches_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [rng.randint(1, packing.CAPACITY) for _ in range(rng.randint(1, 60))]
        got = packing.best_fit(lengths)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(map(sum, brute_bins(lengths)))


def check_packing(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    return len(by)


def test_packing_of_many_small_partitions_makes_few_files(spark, tmp_path):
    """Parts of the result follow from the number of pieces, and no files but the result's are written."""
    held = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(held.iterdir()) if held.exists() else set()
    rows = [(d, 0, 0, 1 + d * 37 % 2047, d) for d in range(1500)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(50)
    out = packing.pack(pieces, task_items=500)
    out.write.parquet(f"{tmp_path}/out")
    assert 1 <= len(list((tmp_path / "out").glob("part-*"))) <= 3
    assert (set(held.iterdir()) if held.exists() else set()) == before
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500)) and check_packing(got) >= 1


def test_texts_to_be_packed_reach_a_worker_in_small_batches(spark):
    rows = [(d, "a b c") for d in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            n = b.num_rows
            yield pa.record_batch([b.column(0), pa.array([0] * n, pa.int32()), pa.array([0] * n), pa.array([n] * n), pa.array([0] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    out = packing.pack(docs.mapInArrow(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    assert max(r["length"] for r in out.collect()) <= 1000 and spark.conf.get(key) == before


def test_packing_rounds(spark):
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.choice([rng.randint(1, 300), rng.randint(900, 2048)]), i) for i in range(5000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(pieces.repartition(8), task_items=700).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(5000))
    assert check_packing(out) <= 1.02 * len(packing.best_fit([r[3] for r in rows])) + 1


def test_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    path = packing.public_path()
    t = Tokenizer.from_file(path)
    texts = {1: "Hello, world! it's WE'LL", 2: None, 3: "", 4: "ΑΣ ΣΑΣ. a\x1cb\x85c <|endoftext|>x", 5: "word " * 5000, 6: "café ½ 12,5 中文"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.pieces_of(df.unionByName(df), keep_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in texts.items():
        want = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = [r for r in rows if r["doc_id"] == i]
        parts = -(-len(want) // packing.CAPACITY)
        assert len(own) == 2 * parts
        for r in own:
            data = np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert bytes(r["ids"]) == data and r["ids_crc32"] == zlib.crc32(data) and r["start"] == r["piece"] * packing.CAPACITY
    assert check_packing(packing.pack_documents(df.unionByName(df)).collect()) >= 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_marks_beside_letters():
    """A fresh encoder, so no run is known from another text."""
    rng = random.Random(7)
    path = packing.public_path()
    encoder = packing.Encoder(path)
    marks = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + ["\u0301", "\u0338", "'s", "<|endoftext|>", "…", "«"]
    letters = ["word", "É", "it", "Σας", "中文", "7", "ße", "ﬁn", "İ"]
    for _ in range(1500):
        text = " ".join("".join(rng.choice(letters if rng.random() < 0.5 else marks) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4)))
        (got,) = encoder.encode([text])
        assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_an_encoder_forgets():
    """Past 200,000 runs an encoder drops all but the first ones, and its ids stay those of the tokenizer."""
    encoder = packing.Encoder(packing.public_path())
    for lo in range(0, 210_000, 30_000):
        texts = [" ".join(f"w{i}" for i in range(k, k + 1000)) for k in range(lo, lo + 30_000, 1000)]
        ids = encoder.encode(texts)
        assert len(encoder.known) <= 200_000
        assert np.frombuffer(ids[0], "<u4").tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(["w1 w209999"])[0], "<u4").tolist() == encoder.tokenizer.encode("w1 w209999", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def toxic(spark):
    rng, rows, labels = random.Random(7), [], []
    plain = [w for s in EN for w in s.split()]
    hidden = {"idiot": ["idiot", "1diot", "idi0t", "i d i o t", "idiooooot"], "scumbag": ["scumbag", "scumb@g", "$cumbag", "s-c-u-m-b-a-g"]}
    for i in range(900):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                word = rng.choice(list(hidden))
                words.insert(rng.randrange(30), hidden[word][0] if rng.random() < 0.6 else rng.choice(hidden[word]))
        rows.append((i, " ".join(words), "en", "s"))
        if i % 10 != 9:
            labels.append((i, 1, int(bad)))
    return docs(spark, rows + [(2000, None, None, None), (2001, "", None, None)]), spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(toxic):
    d, labels = toxic
    scorer = toxicity.learn(d, labels)
    rows = toxicity.score(d, scorer).where(toxicity.held_out(F.col("doc_id")) | (F.col("doc_id") >= 2000)).collect()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    right = [(r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in rows if r["doc_id"] < 2000]
    assert len(right) > 150 and sum(right) >= 0.97 * len(right)
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] >= 2000)
    read = lambda t: toxicity.restore(t, scorer.model)
    assert [read(x) for x in ("the 1diot went", "the i d i o t went", "idiooooot", "scumb@g")] == ["the idiot went", "the idiot went", "idiot", "scumbag"]
    assert read("the house and the garden") == "the house and the garden"


def test_letters_repeated_beyond_latin():
    model = toxicity.CharModel.of(np.ones(toxicity.GRAMS, np.int64))
    for w in ("дуррррак", "βλάαααακα", "głuuuupi", "żółłłłty"):
        assert toxicity._hints(f"the {w} went")[1] and toxicity.restore(f"the {w} went", model) != f"the {w} went"
    assert not toxicity._hints("the дурак went")[1]


def test_toxicity_without_labels(spark, toxic):
    d, labels = toxic
    scorer = toxicity.learn(d, labels.limit(0))
    assert toxicity.score(d, scorer).where("predicted = 1").count() == 0
    assert toxicity.score(d.limit(0), scorer).count() == 0


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(3)
    model = toxicity.CharModel.of(rng.integers(0, 9, toxicity.GRAMS))
    import itertools

    from maqta.llm.letters import class_table

    def score(text):
        c = [0, 0, *(int(class_table()[ord(x)]) for x in text), 0]
        return sum(float(model.logp[c[i], c[i + 1], c[i + 2]]) for i in range(len(c) - 2))

    for token in ("st4r", "a1b1c", "l00k", "p@@s"):
        grid = toxicity.lattice(token)
        if any(" " in p or p.isdigit() for o in grid for p, _ in o):
            grid = [[(p, c) for p, c in o if p.isalpha() or p == ""] for o in grid]
        best = max((sum(c for _, c in path) + score("".join(p for p, _ in path)) for path in itertools.product(*grid)))
        got = model.decode(grid)
        assert max(sum(c for _, c in path) + score(got) for path in itertools.product(*grid) if "".join(p for p, _ in path) == got) == pytest.approx(best)
