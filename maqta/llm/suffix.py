"""Removal of repeated byte strings: column-wise construction of a multi-document suffix structure.

A 200-byte string is repeated if it starts at two places or more.  Windows are brought together by
content first: the least hash among the 100-byte strings inside a window is its anchor, and a run of
windows with one anchor is a fragment.  Equal windows have equal anchors at equal places, so only
fragments that share an anchor need to be compared.  Equal fragments are one string with a weight, the
number of times it stands in the input.

An anchor's strings are a collection.  ``collection`` builds its Burrows-Wheeler transform and the lengths of common
prefixes by inserting one symbol of every string a round, last symbols first, each round reading the structures of the
round before from front to back and writing new ones.  Windows that are equal are neighbours with a
common prefix of a window's length, and they are repeated if their strings weigh two or more together.  The anchor,
which a collection's strings share, is one symbol; that they do share it is checked byte by byte.  A collection of
one string needs no order: its windows weigh what it weighs.

An anchor with very many strings is split by the bytes beside it: windows that start up to k bytes before the
anchor share more than the anchor with their equals, so runs of such windows are told apart by that longer string, down
to single windows if need be.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.llm.common import Spans, byte_table, drop_written, partitions, pieces, roll64, salted, table, text_buffers, tidy, written

WINDOW = 200
ANCHOR = 100
#: Strings that are put into one structure, about, and strings of one anchor above which it is split.
COLLECTION, SPLIT = 2000, 2000
#: Bytes of a text that are worked on at once.
PART = 1 << 20
_BYTES = byte_table(10)


def anchored(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Fragments of texts laid end to end: text number, first window, windows, offset of the anchor in the first
    window, anchor hash, fragment hash.  Starts count from the text's own first byte."""
    n, span = len(data), window - anchor + 1
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = roll64(_BYTES[data], anchor)
    low = np.uint64((1 << 32) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < span:  # least value of the next ``span`` anchors, by doubling
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    place = (best & low).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(place)), "right") - 1 if len(offsets) > 2 else np.zeros(len(place), np.int64)
    inside = np.arange(len(place)) + window <= offsets[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    place, text = place[starts], text[starts]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(starts)) - 1
    p0, p1, a, of = starts[first], starts[last], place[first], text[first]
    whole = Spans(data)(p0, p1 + window)
    return of, p0 - offsets[of], p1 - p0 + 1, a - p0, h[a].astype(np.int64), whole.astype(np.int64)


def text_parts(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """(data, offsets, first byte) of texts laid end to end, a text of more than ``PART`` bytes in parts that overlap by a window.

    Where parts meet a fragment ends early; its windows and their anchors stay what they are.
    """
    if len(offsets) > 2 or len(data) <= PART + window:
        yield data, offsets, 0
        return
    for lo in range(0, max(1, len(data) - window + 1), PART):
        part = data[lo : lo + PART + window - 1]
        yield part, np.array([0, len(part)]), lo


FRAGMENT = "anchor long, frag long, row_key long, start long, n_win int, lead int"


def fragments(docs: DataFrame) -> DataFrame:
    """All fragments of the texts of ``docs`` (row_key, text)."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PART):
                keys = batch.column(0).to_numpy()
                for data, offsets, base in text_parts(*text_buffers(batch.column(1))):
                    of, start, n_win, lead, anchor, frag = anchored(data, offsets)
                    yield pa.record_batch([pa.array(anchor), pa.array(frag), pa.array(keys[of]), pa.array(start + base), pa.array(n_win.astype(np.int32)), pa.array(lead.astype(np.int32))], names=["anchor", "frag", "row_key", "start", "n_win", "lead"])

    return docs.select("row_key", "text").mapInArrow(tidy(run), FRAGMENT)


def _least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least values over [lo, hi] from tables of powers of two."""
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.uint8)
    for level in np.unique(k):
        m = k == level
        t = levels[level]
        out[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << level) + 1])
    return out


def collection(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (0 stands before a string's start), common prefix lengths (at most 255) and
    the rank of each whole string, for strings of symbols 1 to 255 laid end to end.

    Suffixes are sorted as if every string ended with a mark of its own, less than all symbols and in
    the order of the strings.
    """
    n = len(offsets) - 1
    at = offsets[1:] - 1
    bwt = np.where(at >= offsets[:-1], symbols[np.maximum(at, 0)] if len(symbols) else 0, 0).astype(np.uint8)
    lcp = np.zeros(n, np.uint8)
    pos, live = np.arange(n), np.flatnonzero(bwt)
    while len(live):
        m = len(bwt)
        order = np.argsort(bwt, kind="stable")
        held = bwt[order]
        done = int(np.searchsorted(held, 1))
        inverse = np.empty(m, np.int64)
        inverse[order] = np.arange(m)
        rank = inverse[pos[live]]
        new = n + rank - done
        # Common prefixes change at the new suffixes and at those right after them.
        after = rank + 1
        after = after[after < m]
        touched = np.unique(np.concatenate([rank, after]))
        touched = touched[(touched > done) & (held[touched] == held[touched - 1])]
        lo, hi = order[touched - 1] + 1, order[touched]
        levels, size = [lcp], 1
        longest = int((hi - lo).max()) + 1 if len(lo) else 0
        while 2 * size <= longest:
            t = levels[-1]
            levels.append(np.minimum(t[:-size], t[size:]))
            size *= 2
        value = _least(levels, lo, hi)
        value = np.where(value < 255, value + 1, value).astype(np.uint8) if len(value) else value
        keep = np.ones(m + len(live), bool)
        keep[new] = False
        fresh, prefix = np.empty(m + len(live), np.uint8), np.empty(m + len(live), np.uint8)
        fresh[keep], prefix[keep] = bwt, lcp
        at[live] -= 1
        more = at[live] >= offsets[live]
        fresh[new] = np.where(more, symbols[np.maximum(at[live], 0)], 0)
        prefix[new] = 0
        prefix[n + touched - done] = value
        shift = np.sort(new) - np.arange(len(new))
        pos += np.searchsorted(shift, pos, "right")
        pos[live] = new
        bwt, lcp, live = fresh, prefix, live[more]
    return bwt, lcp, pos


#: Symbols: byte values that UTF-8 never has make room for the start mark and the anchor.
_SYMBOL = np.zeros(256, np.uint8)
_USED = [b for b in range(256) if b not in (0xC0, 0xC1) and b < 0xF5]
_SYMBOL[_USED] = np.arange(1, len(_USED) + 1)
_ANCHOR_SYMBOL = 250


def repeated_windows(texts: list[bytes], leads: list[int], weights: np.ndarray, groups: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> list[np.ndarray]:
    """For each of the strings, which have a weight each, which windows stand in strings of their group that weigh two or more."""
    parts = []
    for text, lead in zip(texts, leads, strict=True):
        a = _SYMBOL[np.frombuffer(text, np.uint8)]
        parts += [a[:lead], np.array([_ANCHOR_SYMBOL], np.uint8), a[lead + anchor :]]
    sizes = np.array([len(t) - anchor + 1 for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    bwt, lcp, rank = collection(np.concatenate(parts), offsets)
    follow = np.argsort(bwt, kind="stable")  # rank of a suffix to rank of the suffix without its first symbol
    block = np.cumsum(lcp < window - anchor + 1)
    n_win = np.array([len(t) - window + 1 for t in texts])
    found, owner = [], []
    live, at = np.arange(len(texts)), rank.copy()
    step = 0
    while len(live):
        found.append(block[at[live]])
        owner.append(live)
        step += 1
        live = live[n_win[live] > step]
        at[live] = follow[at[live]]
    found, owner = np.concatenate(found), np.concatenate(owner)
    _, number = np.unique(found * (int(groups.max()) + 1) + groups[owner], return_inverse=True)
    again = (np.bincount(number, weights=weights[owner]) > 1)[number]
    by = np.argsort(owner, kind="stable")  # windows come step by step, so those of one string stay in order
    return np.split(again[by], np.cumsum(n_win)[:-1])


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _resolve(contested: DataFrame) -> DataFrame:
    """anchor, frag, off, lo, hi: runs of repeated windows of the strings (anchor, part, frag, off, lead, n, bytes) of each group (anchor, part).

    Rows come sorted by group in each partition; whole groups make a collection.
    """

    def flush(rows: list[tuple]):
        heads = [(r[0], r[1], r[6][r[4] : r[4] + ANCHOR]) for r in rows]  # an anchor's hash alone does not make a group
        number = {h: i for i, h in enumerate(dict.fromkeys(heads))}
        groups, weights = np.array([number[h] for h in heads]), np.array([r[5] for r in rows])
        cols: list[list] = [[] for _ in range(5)]
        for r, flags in zip(rows, repeated_windows([r[6] for r in rows], [r[4] for r in rows], weights, groups), strict=True):
            for lo, hi in zip(*runs_of(flags), strict=True):
                for c, v in zip(cols, (r[0], r[2], r[3], r[3] + int(lo), r[3] + int(hi) - 1), strict=True):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "frag", "off", "lo", "hi"])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if len(rows) >= COLLECTION and rows[-1][:2] != row[:2]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    return contested.select("anchor", "part", "frag", "off", "lead", "n", "bytes").mapInArrow(tidy(run), "anchor long, frag long, off int, lo int, hi int")


STRING = "anchor long, part long, frag long, off int, lead int, n long, bytes binary, level int"


def _split(large: DataFrame) -> DataFrame:
    """Strings of large groups cut in two: windows that start more, and less, than half as far before the anchor as they may.

    At level k windows start within 2**-k of the anchor's length of each other, so equal ones share the anchor and
    what all windows of their half hold beside it, which names the new group.  ``off`` is the string's first window in its fragment.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for anchor, frag, off, lead, n, text, level in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                level += 1
                bounds = [-(-ANCHOR_SPAN * k // (1 << level)) for k in range((1 << level) + 1)]
                n_win = len(text) - WINDOW + 1
                for least, above in zip(bounds[:-1], bounds[1:], strict=True):
                    # Windows whose anchor is at an offset from ``least`` to ``above`` - 1.
                    lo, hi = max(0, lead - above + 1), min(n_win - 1, lead - least)
                    if least >= above or lo > hi:
                        continue
                    core = text[lead - least : lead + WINDOW - above + 1]
                    part = int.from_bytes(hashlib.blake2b(core + bytes([level]) + least.to_bytes(2, "little"), digest_size=8).digest(), "little", signed=True)
                    for c, v in zip(out, (anchor, part, frag, off + lo, lead - lo, n, text[lo : hi + WINDOW], level), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in STRING.split(", ")])

    return large.select("anchor", "frag", "off", "lead", "n", "bytes", "level").mapInArrow(tidy(run), STRING)


#: Offsets that an anchor may have in a window.
ANCHOR_SPAN = WINDOW - ANCHOR + 1


def _small_groups(cut: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Strings in groups of at most ``SPLIT``, or of one content; and the tables to drop afterwards."""
    done, tables, large = [], [], cut
    for level in range(ANCHOR_SPAN.bit_length() + 1):
        sizes = written(large.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SPLIT), "large-groups")
        tables.append(sizes)
        if level == ANCHOR_SPAN.bit_length() or not sizes.head(1):
            done.append(large)
            break
        whole = salted(large.withColumn("_at", F.xxhash64("anchor", "part")), sizes.select(F.xxhash64("anchor", "part").alias("_at"), "size"), "_at", F.col("frag"), how="left").drop("_at")
        done.append(whole.where("size is null").drop("size"))
        large = written(_split(whole.where("size is not null")), "split-groups")
        tables.append(large)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, tables


def with_key(docs: DataFrame, doc_id: Column | None = None) -> DataFrame:
    """doc_id, text, row_key: a key by content, so that equal rows share it and get the same answer."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))


def _free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(row_key, first, last): first and last start of runs of repeated windows, of ``docs`` (doc_id, text, row_key);
    (row_key, text) of the rows concerned; and the tables to drop when both have been used."""
    spark = docs.sparkSession
    frags = written(fragments(docs), "fragments")
    shared = written(frags.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    _free(spark)
    again = written(salted(frags, shared, "anchor", F.col("row_key")), "shared-fragments")
    drop_written(frags, shared)
    _free(spark)
    texts = written(docs.join(again.select("row_key").distinct(), "row_key", "left_semi").select("row_key", "doc_id", "text"), "texts")
    _free(spark)
    one = F.min(F.struct("row_key", "start", "n_win", "lead")).alias("x")
    strings = written(again.groupBy("anchor", "frag").agg(F.count(F.lit(1)).alias("n"), one).select("anchor", "frag", "n", "x.*"), "strings")
    varied = written(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "varied-anchors")
    # Texts are cut into strings where they are, so that only strings travel on.
    contested = salted(strings, varied, "anchor", F.col("frag"))
    lists = contested.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "frag", "start", "n_win", "lead", "n")).alias("frags"))
    piece = "named_struct('anchor', f.anchor, 'frag', f.frag, 'lead', f.lead, 'n', f.n, 'bytes', substring(raw, int(f.start) + 1, f.n_win + %d))" % (WINDOW - 1)
    cut = texts.dropDuplicates(["row_key"]).join(lists, "row_key").select(F.encode("text", "UTF-8").alias("raw"), "frags")
    cut = cut.select(F.expr(f"transform(frags, f -> {piece})").alias("c")).select(F.explode("c").alias("c")).select("c.*")
    nothing = F.lit(0).cast("int")
    cut = written(cut.select("anchor", F.lit(0).cast("long").alias("part"), "frag", nothing.alias("off"), "lead", "n", "bytes", nothing.alias("level")), "contested")
    _free(spark)
    groups, tables = _small_groups(cut)
    found = _resolve(groups.repartition(partitions(spark), "anchor", "part").sortWithinPartitions("anchor", "part")).select("anchor", "frag", "lo", "hi")
    # A collection of one string: its windows weigh what it weighs.
    alone = strings.where("n > 1").join(varied, "anchor", "left_anti").select("anchor", "frag", nothing.alias("lo"), (F.col("n_win") - 1).alias("hi"))
    found = written(found.unionByName(alone), "repeats")
    drop_written(strings, varied, cut, *tables)
    _free(spark)
    per = found.groupBy("anchor", "frag").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).withColumn("_at", F.xxhash64("anchor", "frag"))  # as many as windows, at most
    hits = salted(again.withColumn("_at", F.xxhash64("anchor", "frag")), per.withColumnRenamed("anchor", "a").withColumnRenamed("frag", "f"), "_at", F.col("row_key")).where("anchor = a and frag = f")
    spans = hits.select("row_key", "start", F.explode("runs").alias("r")).select("row_key", (F.col("start") + F.col("r.lo")).alias("first"), (F.col("start") + F.col("r.hi")).alias("last"))
    spans = written(spans, "spans")
    drop_written(again, found)
    _free(spark)
    return spans, texts, [spans, texts]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(rows: DataFrame, keep: bool) -> DataFrame:
    """Takes the spans out of each text of (doc_id, text, firsts, lasts)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                delta = np.zeros(len(raw) + 1, np.int64)
                np.add.at(delta, np.array(firsts, np.int64), 1)
                np.add.at(delta, np.array(lasts, np.int64) + WINDOW, -1)
                flags = np.cumsum(delta[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~flags].tobytes()
                out.append((doc_id, len(raw), int(flags.sum()), len(runs_of(flags)[0]), hashlib.sha256(kept).hexdigest(), kept if keep else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", "text", "firsts", "lasts").mapInArrow(tidy(run), SCHEMA)


def remove_repeats(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null without ``keep``) of every row of ``docs``.

    Null texts are empty.  Equal rows repeat each other whole if they have 200 bytes.  What is left may be
    no valid UTF-8, so ``kept`` is binary.
    """
    keyed = with_key(docs)
    spans, texts, _ = repeated_spans(keyed)
    per = written(spans.groupBy("row_key").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")), "row-spans")
    drop_written(spans)
    touched = texts.join(per, "row_key")
    ids = keyed.select("row_key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"), *([F.encode("text", "UTF-8").alias("kept")] if keep else []))
    rest = ids.join(per.select("row_key"), "row_key", "left_anti")
    rest = rest.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", (F.col("kept") if keep else F.lit(None).cast("binary")).alias("kept"))
    return _cut(touched, keep).unionByName(rest)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")
