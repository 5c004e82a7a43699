"""Best-fit packing of token sequences, by hierarchical residual packing.

Each partition packs its items best-fit in decreasing order and emits the bins that are nearly
full.  Underfull bins are items of the next round, which has fewer partitions (a tree merge), down to one or to as
many as hold ``TASK_ITEMS`` bins each; the last round emits all bins.  Partitions follow from the number of pieces alone.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.llm.common import batches_of, table, tidy

CAPACITY = 2048
END_ID = 0
#: Spare places in a bin that counts as nearly full.
SPARE = 8
#: Items that one task packs at once, and partitions that one partition of the next round takes in.
TASK_ITEMS = 20_000
FAN_IN = 4
#: Runs that an encoder knows at most, and keeps from task to task: those it saw first, which are the frequent ones.
CACHE, KEPT = 200_000, 100_000
#: Texts that an encoder is given at once.
TEXTS = 64
#: White space as the tokenizer's normaliser knows it, where Python's str.split() knows more.
ONLY_PYTHON_SPACE = "\x1c\x1d\x1e\x1f"
#: Marks that the tokenizer always parts from letters before them; "'" may stand with letters and the others in special tokens.
MARKS = "".join(c for c in string.punctuation if c not in "'<|>")
VOCABULARY = "word_bpe_49k.json"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space, and no rule of it reaches over white space, so a text's ids are
    those of its runs of other characters in turn; runs are encoded once and kept.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def shared(cls, path: str) -> "Encoder":
        """One encoder for each Python worker, which keeps what it knows from task to task."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def trim(self) -> None:
        """Forgets all but the runs seen first."""
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), KEPT))

    @staticmethod
    def runs(text: str) -> list[str]:
        # The tokenizer composes, then folds case letter by letter; where Python's folding is the same and stays composed, fold at once.
        if text.isascii() or (unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text):
            if "<|" not in text:
                text = text.lower()
        if any(c in text for c in ONLY_PYTHON_SPACE):
            import regex

            return regex.findall(r"[^\p{White_Space}]+", text)
        return text.split()

    def _encode(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each run with its ids.  A run of letters has one token that ends a word, its last, so such runs go to the
        tokenizer as one text and are told apart by those tokens."""
        letters = [r for r in runs if r.isalpha()]
        for lo in range(0, len(letters), 500):
            group = letters[lo : lo + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                for r in group:
                    yield r, self._alone(r)
                continue
            data, at = ids.tobytes(), 0
            for r, end in zip(group, (4 * ends).tolist(), strict=True):
                yield r, data[at:end]
                at = end
        for r in runs:
            if not r.isalpha():
                yield r, self._alone(r)

    def _alone(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, runs: set[str]) -> None:
        known = self.known
        todo = [r for r in runs if r not in known]
        if len(known) + len(todo) > CACHE:
            self.trim()
            known = self.known
            todo = [r for r in runs if r not in known]
        # Letters with marks after them have the ids of the letters and of the marks; "İ" folds to a letter and a mark.
        split, plain = [], set()
        for r in todo:
            word = r if r.isalpha() else r.rstrip(MARKS)
            if word != r and word.isalpha() and "İ" not in word:
                split.append((r, word, r[len(word) :]))
                plain.update(split[-1][1:])
            else:
                plain.add(r)
        known.update(self._encode([p for p in plain if p not in known]))
        for r, word, marks in split:
            known[r] = known[word] + known[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.runs(t) for t in texts]
        self.learn({r for rs in split for r in rs})
        get = self.known.__getitem__
        return [b"".join(map(get, rs)) for rs in split]


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids: each text's ids with ``END_ID`` after them, cut at ``capacity``.

    Null texts are empty: one piece of one id.  Every row gives its own pieces, repeated ids too.  Texts of any length are
    encoded whole.  An empty table gives none.  Columns besides doc_id and text are ignored.
    """

    def run(batches):
        encoder = Encoder.shared(path or public_path())
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                ids = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
                rows = []
                for doc_id, data in zip(batch.column(0).to_pylist(), ids, strict=True):
                    data += END_ID.to_bytes(4, "little")
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        encoder.trim()

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers, best fit in decreasing order: each item goes where the least space stays."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by space left
    open_rooms, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[i]
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_size long, nearly_full boolean, offset long"


def _round(df: DataFrame, capacity: int, last: bool, level: int) -> DataFrame:
    """Packs each partition's bins (rows of one bin stand together by ``bin``; a null one is a lone piece)."""

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        names = t.column("bin").to_numpy()
        order = np.lexsort((t.column("offset").to_numpy(), names))
        lengths, names = t.column("length").to_numpy()[order], names[order]
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        ends = np.append(starts[1:], len(names))
        sizes = np.add.reduceat(lengths, starts)
        task = TaskContext.get().partitionId()
        rows, place, of, full = [], [], [], []
        for n, members in enumerate(best_fit(sizes.tolist(), capacity)):
            size = int(sizes[members].sum())
            at = 0
            for m in members:
                for k in range(starts[m], ends[m]):
                    rows.append(order[k])
                    place.append(at)
                    of.append(n)
                    at += int(lengths[k])
            full += [(size, last or size >= capacity - SPARE)] * sum(int(ends[m] - starts[m]) for m in members)
        t = t.select(PIECE).take(pa.array(rows))
        base = (level << 56) | (task << 32)
        cols = [pa.array(np.array(of, np.int64) + base), pa.array([x[0] for x in full], pa.int64()), pa.array([x[1] for x in full], pa.bool_()), pa.array(place, pa.int64())]
        for c, name in zip(cols, ("bin", "bin_size", "nearly_full", "offset"), strict=True):
            t = t.append_column(name, c)
        yield from t.combine_chunks().to_batches()

    return df.select(*PIECE, "bin", "offset").mapInArrow(tidy(run), PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, task_items: int = TASK_ITEMS) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; an empty table gives none.

    No piece is longer than ``capacity``.  Pieces of full length are sequences of their own.  Of bins that fit a piece
    equally well the one that got so little room last is taken.

    Pieces and rounds are kept on the executors' disks, and what is lost is made again, the same: rows of a round are
    ordered by their bins.  As files they would be one for each small partition of the input and of each round, and
    where Hadoop has no native library every new file forks the executor's JVM.
    """
    lone = F.monotonically_increasing_id()
    rows = pieces.select(*PIECE, lone.alias("bin"), F.lit(0).cast("long").alias("offset")).persist(StorageLevel.DISK_ONLY)
    done = [rows.where(F.col("length") >= capacity).withColumn("bin", F.col("bin") + F.lit(1 << 55)).select(*PIECE, F.col("bin").alias("sequence_id"), "offset")]
    with batches_of(pieces.sparkSession):  # this makes the pieces, of texts that may be long
        total = rows.count()
    left, level = rows.where(F.col("length") < capacity), 1
    n, last = max(1, -(-total // task_items)), False
    files = n
    while True:
        last = last or n == 1
        # Bins are dealt out by a hash of their number, so every partition sees the same mix of sizes.
        dealt = left.repartition(n, F.xxhash64("bin", F.lit(level)))
        packed = _round(dealt, capacity, last, level).persist(StorageLevel.DISK_ONLY)
        done.append(packed.where("nearly_full").select(*PIECE, F.col("bin").alias("sequence_id"), "offset"))
        left = packed.where(~F.col("nearly_full"))
        if last:
            break
        now = left.where("offset = 0").count()
        if now == 0:
            break
        fewer = max(1, -(-now // task_items), n // FAN_IN)
        last = fewer >= n  # so many bins are left that no partition can take in another
        level, n = level + 1, min(n, fewer)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.coalesce(files)  # else a partition for each of the input's and of every round's


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(table(spark, sf_dir, "documents")))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, size, members: the sequences in full, each a bounded list of pieces by offset."""
    member = F.struct("offset", "doc_id", "piece", "start", "length")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("size"), F.array_sort(F.collect_list(member)).alias("members"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` with their place in sequences."""
    return pack(pieces_of(docs, path, capacity), capacity)
