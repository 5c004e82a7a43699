"""Jaccard join, repeated byte strings, fingerprints and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from maqta.llm import common, fingerprint, jaccard, suffix
from maqta.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def word_sets(rows):
    out = {}
    for i, t in rows:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near_copies(seed, n=150):
    rng, vocabulary, rows = random.Random(seed), [f"w{i}" for i in range(40)], []
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 12, 40, 80]))] for _ in range(12)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        text = rng.choice([" ", "\n", "\t  "]).join(w)
        rows.append((i, text.upper() if i % 3 else text))
    return rows


ODD = [(900, None), (901, ""), (902, "  "), (903, "a"), (904, "A"), (905, "É b"), (906, "é b"), (907, "a b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = near_copies(seed) + ODD
    want, sets = brute_components(word_sets(rows)), word_sets(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    if seed == 1:
        kept = jaccard.one_of_each(df.unionByName(df)).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(k for k, v in want.items() if k == v)


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(9)]
    rows = [(7, t) for t in texts[:4]] + [(None, t) for t in texts[4:8]] + [(None, None), (None, ""), (7, "")]
    # Copies: one id on rows of two components, a null id beside an id, repeats of whole rows.
    rows += [(3, texts[0]), (9, texts[5]), (7, texts[8]), (8, texts[8]), (7, texts[1]), (None, texts[6])]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(3, texts[0]), *((7, t) for t in texts[1:4]), (None, texts[4]), (9, texts[5]), (None, texts[6]), (None, texts[7]), (None, None), (None, ""), (7, ""), (7, texts[8])]
    assert Counter(map(tuple, kept)) == Counter(want)


def test_jaccard_links_rows_without_ids(spark):
    rng = random.Random(12)
    w = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    chain = [" ".join(w[k : k + 60]) for k in (0, 4, 8, 12)]  # neighbours are linked, others are not
    other = " ".join(w[::-1])
    rows = [(5, chain[0]), (None, chain[1]), (None, chain[1]), (0, chain[2]), (None, chain[3]), (None, other), (None, other + " more"), (0, "a b"), (0, other + " a b")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    count = Counter((r["doc_id"], r["component_id"]) for r in got)
    assert count == {(5, 0): 1, (None, 0): 5, (0, 0): 3}
    got = jaccard.jaccard_components(spark.createDataFrame([(5, chain[0]), (None, chain[1]), (7, chain[2]), (None, other), (None, other + " x")], "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == {(5, 5): 1, (None, 5): 1, (7, 5): 1, (None, None): 2}
    kept = jaccard.one_of_each(spark.createDataFrame([(None, other), (None, other + " x"), (None, chain[0])], "doc_id long, text string")).collect()
    assert len(kept) == 2


def test_jaccard_with_one_leader_leaves_nothing_out(spark, monkeypatch):
    rows = near_copies(3, 120)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 1)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(word_sets(rows))


def test_jaccard_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_in_polynomials_are_told_apart(spark, n):
    words = [thue_morse(n, *p) for p in ("ab", "ba", "xy", "yx")]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(rows).collect()} == {i: i for i in range(4)}
    assert len({fingerprint.fingerprint(w) for w in words}) == 4


def test_hashes_of_spans_follow_their_content():
    rng = np.random.default_rng(13)
    data = np.tile(rng.integers(0, 256, 137).astype(np.uint8), 6)
    start = np.arange(500)
    for width in (1, 7, 100, 137):
        h, r = common.Spans(data)(start, start + width), common.roll64(common.byte_table(3)[data], width)
        assert (h[:363] == h[137:]).all() and (r[:363] == r[137:500]).all()
        assert len(np.unique(h)) == len({data[i : i + width].tobytes() for i in start})
    a, b = rng.integers(0, (1 << 61) - 1, (2, 50)).astype(np.uint64)
    assert common.multiply61(a, b).tolist() == [int(x) * int(y) % ((1 << 61) - 1) for x, y in zip(a, b, strict=True)]


def test_block_pairs_are_all_pairs_that_size_and_position_allow(spark):
    rng, rows = random.Random(14), []
    for token in range(6):
        for k in range(40):
            n = rng.randint(1, 60)
            rows.append((token, 100 * token + k, n, rng.randrange(jaccard.prefix_length(n)), rng.randint(0, 9)))
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]:
                (n, p), (m, q) = a[2:4], b[2:4]
                if 100 * min(n, m) >= 80 * max(n, m) and 180 * min(n - p, m - q) >= 80 * (n + m):
                    want.add((a[1], b[1]))
    got = jaccard.block_pairs(spark.createDataFrame(rows, "token long, node long, n int, pos int, label long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        parent[max(x, y)] = min(x, y)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    linked = {n for u, v in edges if u != v for n in (u, v)}
    assert got == {n: find(n) for n in linked}


def test_collection_matches_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(80):
        strings = [[rng.randint(1, 3) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 7))]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        bwt, lcp, rank = suffix.collection(np.array(sum(strings, []), np.uint8), offsets)
        ordered = sorted((tuple((c,) for c in s[i:]) + ((0, k),), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        common = [0] + [next((n for n, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), 0) for a, b in zip(ordered[:-1], ordered[1:], strict=True)]
        assert bwt.tolist() == [strings[k][i - 1] if i else 0 for _, k, i in ordered]
        assert lcp.tolist() == common and [ordered[q][1:] for q in rank] == [(k, 0) for k in range(len(strings))]


def repeats(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + 200] for _, r in raws for p in range(len(r) - 199))
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(c for c, x in zip(r, gone, strict=True) if not x)
        yield i, len(r), sum(gone), sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("large", [2000, 3])
def test_repeated_strings(spark, monkeypatch, large):
    monkeypatch.setattr(suffix, "SPLIT", large)
    monkeypatch.setattr(suffix, "PART", 1 << 20 if large > 3 else 700)
    rng = random.Random(6)
    draw = lambda n: "".join(rng.choice("abcdéß ") for _ in range(n))
    passages, rows = [draw(rng.randint(150, 600)) for _ in range(5)], []
    for i in range(60):
        text = draw(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            p = p[rng.randint(0, 60) : len(p) - rng.randint(0, 80)]
            if rng.random() < 0.5:
                k = rng.randrange(len(p))
                p = f"{p[:k]}X{rng.randint(0, 9)}{p[k + 1 :]}"
            text += p + draw(rng.choice([0, 1, 5, 90]))
        rows.append((i, text))
    rows += [(200, "a" * 900), (201, None), (202, ""), (203, rows[3][1]), (3, rows[3][1]), (204, "ab" * 300), (205, "x" * 199), (206, "x" * 199), (None, "z" * 300)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(repeats(rows))
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_repeated_strings_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_do_not_depend_on_place():
    rng = np.random.default_rng(7)
    common = rng.integers(97, 123, 450).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, n).astype(np.uint8), common, rng.integers(97, 123, 77).astype(np.uint8)]) for n in (13, 250))

    def windows(x):
        _, start, n_win, lead, anchor, _ = suffix.anchored(x, np.array([0, len(x)]))
        assert n_win.sum() == len(x) - 199
        return {bytes(x[s + k : s + k + 200]): (h, o - k) for s, n, o, h in zip(start, n_win, lead, anchor, strict=True) for k in range(n)}

    x, y = windows(a), windows(b)
    shared = x.keys() & y.keys()
    assert len(shared) == 251 and all(x[w] == y[w] for w in shared)


def test_collisions_follow_generalised_jaccard():
    rng, sampler = random.Random(8), fingerprint.Sampler.shared()
    for _ in range(6):
        terms = rng.sample(range(1 << 16), 60)
        a, b = ({t: rng.randint(1, 4) for t in rng.sample(terms, 45)} for _ in range(2))
        marks = [sampler.signature(np.array(sorted(x)), np.array([x[t] for t in sorted(x)])) for x in (a, b)]
        least = sum(min(a.get(t, 0), b.get(t, 0)) for t in terms)
        most = sum(max(a.get(t, 0), b.get(t, 0)) for t in terms)
        assert (marks[0] == marks[1]).mean() == pytest.approx(least / most, abs=0.16)


@pytest.mark.parametrize("shared", [0, 20_000])
def test_long_texts_agree_as_their_unfolded_pairs_do(shared):
    rng = np.random.default_rng(10)

    def words(n):
        return [f"w{i}" for i in rng.integers(0, 1 << 40, n)]

    both = words(shared)
    a, b = (both + words(60_000 - shared) for _ in range(2))
    if shared:
        b += b[:3000] * 2  # pairs of greater weight
    x, y = (Counter(zip(t, t[1:])) for t in (a, b))
    exact = (x & y).total() / (x | y).total()
    marks = [fingerprint.fingerprint(" ".join(t)) for t in (a, b)]
    assert fingerprint.likeness(*marks) == pytest.approx(exact, abs=0.15 if shared else 0.02)


def test_offers_have_the_laws_of_gamma_sampling():
    sampler = fingerprint.Sampler.shared()
    for weight in (1, 2, 7, 50):  # a least value that is exponential, with the weight as its rate
        value, level = sampler.weighted(sampler.hashes(np.arange(1000, 3000)), np.full(2000, weight))
        assert value.mean() * weight == pytest.approx(1, abs=0.02) and (value**2).mean() * weight**2 == pytest.approx(2, abs=0.1)
        assert (level == 0).all() if weight == 1 else (level >= 0).all()
    marks = np.array([[sampler.signature(np.array([t]), np.array([w])) for w in (3, 7)] for t in range(200)])
    assert (marks[:, 0] == marks[:, 1]).mean() == pytest.approx(3 / 7, abs=0.02)


def test_fingerprints(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "tide", "é", "star"]) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[5][1]), (103, "abc"), (104, "x" * 5000), (None, "no id"), (7, "second of seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), [-ord(c) for c in r[1] or ""] + [1]))
    want = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        e = fingerprint.edited(t, n)
        a, b, c = map(fingerprint.fingerprint, (t, e, n))
        want[i, a] = (len(t), hashlib.sha256(e.encode()).hexdigest(), b, fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    got = {(r["doc_id"], r["fingerprint"]): tuple(r)[1:3] + tuple(r)[4:] for r in fingerprint.fingerprints(df.repartition(5)).collect()}
    assert got == want
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    alone = fingerprint.fingerprints(df.where("doc_id = 103")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 3


def test_edited():
    assert fingerprint.edited("abcde", "xyz") == "abcxy" and fingerprint.edited("abcdef", "x") == "abcx" and fingerprint.edited("", "x") == ""
