"""Unit vectors: hashed TF-IDF over stems and their letter n-grams, or any function of texts.

A document's units are one row with arrays here, since inverse document frequencies are a document's own.  The
hashing embedder runs document by document in vectorised Python: the native form (``features``,
``hashed_vectors``) explodes some forty million features for what is a sixtieth of that in words, and
serves as the statement of what is computed.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maqta.functions.text import NOT_S, normalize_arabic, stems
from maqta.functions.words import Runs, tagged

DIMENSIONS = 2048
NGRAMS = (2, 4)
WORD_WEIGHT = 2.0
KNOWN_RUNS, KNOWN_STEMS, KNOWN_FEATURES = 400_000, 400_000, 800_000
#: Documents, and characters of them, whose words are looked up at once.
TOGETHER, CHARACTERS = 16, 1 << 20
#: Squares of lengths of sums of unit rows below this are those of rows that cancel out.
NOTHING = 1e-13
#: Features of units, repeats included, that are counted at once.
CELLS = 1 << 20
#: Bits of a feature's number, of a unit's place in its document and of a place in its vector, which are sorted as one number.
FEATURE_BITS, UNIT_BITS, PLACE_BITS = 28, 24, 11
#: Gaps whose windows are summed up at once.
GAPS = 16
#: Documents that a Python worker turns into objects at once.
DOCUMENTS = 32


def bounded(batches: Iterable[pa.RecordBatch], most: int = DOCUMENTS) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            yield batch.slice(lo, most)


@dataclass(frozen=True)
class HashingEmbedder:
    """What the built-in embedder is told: dimensions, n-gram sizes, weight of a whole stem, whether to use IDF."""

    dim: int = DIMENSIONS
    ngram_range: tuple[int, int] = NGRAMS
    word_weight: float = WORD_WEIGHT
    use_idf: bool = True

    def rows(self, docs: Iterable[list[str]]) -> Iterable[np.ndarray]:
        """A dense matrix of unit rows for each document, which is a list of texts."""
        for found in self.sparse_rows(docs):
            yield found.dense()

    def sparse_rows(self, docs: Iterable[list[str]]) -> Iterable[SparseRows]:
        """The same rows by what is not 0 in them."""
        for n, found in self._counted(docs):
            yield self._sparse(n, *found)

    def counts(self, docs: Iterable[list[str]]) -> Iterable[tuple[int, float]]:
        """For each document how many features its units have, and their weighted counts in all."""
        for _, (_, _, tf, _) in self._counted(docs):
            yield len(tf), float(tf.sum())

    def _counted(self, docs: Iterable[list[str]]) -> Iterable[tuple[int, tuple]]:
        known, runs = _known(self)
        for group in _groups(docs):
            texts = [u or "" for units in group for u in units]
            numbers, ends = known.numbered(texts, runs)
            at = 0
            for units in group:
                yield len(units), (*known.counted(numbers, ends[at : at + len(units) + 1], at), known)
                at += len(units)

    def _sparse(self, n: int, unit: np.ndarray, feature: np.ndarray, tf: np.ndarray, known: Vocabulary) -> SparseRows:
        few = len(tf) and tf.max() < len(_LOGS) and float(self.word_weight).is_integer()
        value = known.sign[feature] * (_LOGS[tf.astype(np.int64)] if few else 1.0 + np.log(tf))
        if self.use_idf and n > 1 and len(tf):
            value *= known.idf(feature, n)
        return SparseRows.of(n, self.dim, unit, known.bucket[feature], value, self.dim <= 1 << PLACE_BITS)

    def _matrix(self, units: list[list[str]], known: Vocabulary | None = None) -> np.ndarray:
        """A dense matrix for units that are lists of tagged tokens."""
        known = known or Vocabulary(self)
        numbers, ends = known.of_tokens(units)
        return self._sparse(len(units), *known.counted(numbers, ends), known).dense()


def _groups(docs: Iterable[list[str]]) -> Iterable[list[list[str]]]:
    """Neighbouring documents whose words are looked up at once."""
    group, size = [], 0
    for units in docs:
        group.append(units)
        size += sum(len(u or "") for u in units)
        if len(group) >= TOGETHER or size >= CHARACTERS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _runs_of(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


class SparseRows:
    """Rows of length 1 (or 0) of a document's ``n`` units by what is not 0 in them: unit, place and weight, ordered by place and then unit."""

    def __init__(self, n: int, dim: int, unit: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        self.n, self.dim, self.unit, self.place, self.weight = n, dim, unit, place, weight

    @classmethod
    def of(cls, n: int, dim: int, unit: np.ndarray, place: np.ndarray, value: np.ndarray, ordered: bool = False) -> SparseRows:
        """Values of one unit and place are added up, and rows are brought to length 1; ordered: by place and then unit."""
        if not len(value):
            return cls(n, dim, unit, place, value)
        key = place * n + unit
        if ordered:
            at = _runs_of(key)
            value, key = np.add.reduceat(value, at), key[at]
        else:
            bits = len(value).bit_length()
            order = key << bits | np.arange(len(key))  # sorted as one number: faster than sorting places
            order.sort()
            at = _runs_of(order >> bits)
            value = np.add.reduceat(value[order & (1 << bits) - 1], at)
            key = order[at] >> bits
        if not value.all():
            key, value = key[value != 0], value[value != 0]
        place, unit = np.divmod(key, n)
        norm = np.sqrt(np.bincount(unit, value * value, n))
        return cls(n, dim, unit, place, value / norm[unit])

    def __len__(self) -> int:
        return self.n

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.dim))
        out[self.unit, self.place] = self.weight
        return out

    def lengths(self, starts: list[int]) -> np.ndarray:
        """Length of the sum of the rows from each start up to the next."""
        piece = np.repeat(np.arange(len(starts)), np.diff([*starts, self.n]))[self.unit]
        at = _runs_of(self.place * len(starts) + piece)
        if not len(at):
            return np.zeros(len(starts))
        total = np.add.reduceat(self.weight, at)
        return np.sqrt(np.bincount(piece[at], total * total, len(starts)))

    def distances(self, sections: np.ndarray, window: int) -> np.ndarray:
        """``context_distance`` of these rows, no number where sections meet.

        Sums of windows are never made: their lengths and products add up from products of rows that are less than two
        windows apart.
        """
        if not self.n:
            return np.zeros(0)
        reach = 2 * window - 1
        opens = np.concatenate([[False], sections[1:] != sections[:-1]])
        # Rows of 0 before, between and after sections: no window holds rows of two.
        at = np.arange(self.n) + reach * np.cumsum(opens) + reach
        size = int(at[-1]) + 1 + reach
        row, weight = at[self.unit], self.weight
        key = self.place * (size + reach) + row
        near = np.bincount(row, weight * weight, (reach + 1) * size)
        for lag in range(1, min(reach, len(key) - 1) + 1):
            apart = key[lag:] - key[:-lag]
            k = np.flatnonzero(apart <= reach)
            near += np.bincount(apart[k] * size + row[k], weight[k] * weight[k + lag], (reach + 1) * size)
        near = near.reshape(reach + 1, size)
        gap = at[:-1]
        # Square of the length of the window that starts at each place, and products of those on both sides of a gap.
        whole = size - window + 1
        square = sum(near[k, s : s + whole] * (2.0 if k else 1.0) for k in range(window) for s in range(window - k))
        square[square < NOTHING] = 0.0
        norm = np.sqrt(square)
        norm = norm[gap - window + 1] * norm[gap + 1]
        both = sum(near[s + r][gap - s] for s in range(window) for r in range(1, window + 1)) if len(gap) else np.zeros(0)
        out = np.where(norm > 0, 1.0 - both / np.where(norm == 0, 1, norm), 1.0)
        out[opens[1:]] = np.nan
        return out


@functools.lru_cache(maxsize=2)
def _known(embedder: HashingEmbedder) -> tuple[Vocabulary, Runs]:
    """What a Python worker has learnt, which it keeps from task to task."""
    return Vocabulary(embedder), Runs()


class _Numbers(dict):
    """Numbers of keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _latest(numbers: _Numbers, before: int) -> list[str]:
    """The keys from the number ``before`` on."""
    return list(itertools.islice(reversed(numbers), len(numbers) - before))[::-1]


def _room(column: np.ndarray, n: int) -> np.ndarray:
    return column if len(column) >= n else np.concatenate([column, np.zeros(max(n, len(column)), column.dtype)])


#: Checksums of single bytes, the state of a checksum after "c:", and the checksum of "w:".
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)
_OPENED = np.uint32(zlib.crc32(b"c:") ^ 0xFFFFFFFF)
_WORD_OPENED = zlib.crc32(b"w:")
#: 1 + log of small counts.
_LOGS = 1.0 + np.log(np.maximum(np.arange(256), 1))
#: Characters below this have two bytes at most, and four of them a number of their own as an n-gram.
_SHORT_CHARACTER, _SHORT_GRAM = 0x800, 4
#: Bits of a letter's own number, letters counted from 1, in the table of n-grams.
_LETTER_BITS = 6


def _checksums(codes: np.ndarray) -> np.ndarray:
    """Checksums of "c:" and the characters packed into each number."""
    state = np.full(len(codes), _OPENED)
    for k in range(_SHORT_GRAM - 1, -1, -1):
        at = (codes >> 11 * k & 0x7FF).astype(np.uint32)
        more = state >> 8 ^ _CRC[(state ^ np.where(at < 0x80, at, 0xC0 | at >> 6)) & 255]
        more = np.where(at >= 0x80, more >> 8 ^ _CRC[(more ^ (0x80 | at & 63)) & 255], more)
        state = np.where(at > 0, more, state)
    return ~state


class Vocabulary:
    """Tokens and features seen by a worker, numbered as they come; features of a token lie side by side in one array.

    "=x" is a stem, "~x" a word of a unit without stems.  A token's first feature is the word itself, the same for "=x" and "~x".
    N-grams of the letters met first, as many as have a number, are looked up in a table, others by their characters packed into a
    number or by their names.
    """

    def __init__(self, embedder: HashingEmbedder) -> None:
        self.embedder = embedder
        self.clear()

    def clear(self) -> None:
        self.tokens, self.names, self.known = _Numbers(), {}, 0
        self.first, self.width, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 15, np.int64), 0
        self.bucket, self.sign, self.weight = np.zeros(1 << 14, np.int64), np.zeros(1 << 14), np.zeros(1 << 14)
        self.seen = np.zeros(1 << 14, np.int64)
        #: Runs of characters without white space; " x" is the word x of a unit without stems.
        self.runs, self.run_first, self.run_width = _Numbers(), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        #: Features of words of units without stems.
        self.plain: dict[str, int] = {}
        #: Numbers of letters, 0 for those without, and of n-grams by those, counted from 1; only what is touched takes up memory.
        self.letter, self.letters = np.zeros(_SHORT_CHARACTER, np.int64), 0
        low, high = self.embedder.ngram_range
        self.table = np.zeros(1 << _LETTER_BITS * high if 1 <= low <= high <= _SHORT_GRAM else 0, np.int32)

    def _new(self, n: int) -> int:
        """The first of ``n`` numbers for new features."""
        self.known += n
        self.bucket, self.sign, self.weight, self.seen = (_room(x, self.known) for x in (self.bucket, self.sign, self.weight, self.seen))
        return self.known - n

    def _describe(self, number: np.ndarray, crcs: np.ndarray, weight: float) -> None:
        self.bucket[number], self.sign[number], self.weight[number] = crcs % self.embedder.dim, np.where(crcs >> 31, 1.0, -1.0), weight

    def _number_letters(self, at: np.ndarray) -> np.ndarray:
        """Numbers of letters, which new ones get as long as there are any."""
        found = self.letter[at]
        room = (1 << _LETTER_BITS) - 1 - self.letters
        if room and not found.all():
            fresh = np.unique(at[found == 0])[:room]
            self.letter[fresh] = self.letters + 1 + np.arange(len(fresh))
            self.letters += len(fresh)
            found = self.letter[at]
        return found

    def _grams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Owner (place in ``words``) and number of each n-gram of words of short characters."""
        low, high = self.embedder.ngram_range
        at = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) + 2 for w in words])
        owner, ends = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
        left = ends - np.arange(len(at))
        letter, wide, out = self._number_letters(at), at.astype(np.int64), []
        odd = letter == 0
        few = not odd.any()
        code, packed, strange = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for n in range(1, high + 1):
            # One more character of what starts at each place.
            k, size = n - 1, max(0, len(at) - n + 1)
            code, packed = code[:size] << _LETTER_BITS | letter[k:], packed[:size] << 11 | wide[k:]
            strange = strange[:size] if few else strange[:size] | odd[k:]
            if n >= low:
                whole = left[:size] >= n
                out.append((owner[:size][whole], code[whole], packed[whole], strange[whole]))
        owner, code, packed, strange = (np.concatenate(x) for x in zip(*out, strict=True))
        if few:
            return owner, self._looked_up(code, packed)
        number = np.zeros(len(code), np.int64)
        number[~strange] = self._looked_up(code[~strange], packed[~strange])
        number[strange] = self._named(packed[strange].tolist())
        return owner, number

    def _looked_up(self, code: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Numbers of n-grams by the table."""
        number = self.table[code]
        fresh = np.flatnonzero(number == 0)
        if len(fresh):
            own, one = np.unique(code[fresh], return_index=True)
            first = self._new(len(own))
            added = np.arange(first, first + len(own))
            self._describe(added, _checksums(packed[fresh[one]]), 1.0)
            self.table[own] = added + 1
            number[fresh] = self.table[code[fresh]]
        return number.astype(np.int64) - 1

    def _named(self, keys: list[str] | list[int]) -> np.ndarray:
        """Numbers of n-grams by their names, or by their characters packed into a number."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self.names]
        if fresh:
            first = self._new(len(fresh))
            self.names.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            sums = np.array([zlib.crc32(k.encode()) for k in fresh], np.uint32) if isinstance(fresh[0], str) else _checksums(np.array(fresh, np.int64))
            self._describe(np.arange(first, first + len(fresh)), sums, 1.0)
        return np.fromiter(map(self.names.__getitem__, keys), np.int64, len(keys))

    def _words(self, tokens: list[str], base: int) -> np.ndarray:
        """Numbers of the words that new tokens are, which have the numbers from ``base`` on."""
        number, fresh, plain, first = [], [], self.plain, self.known
        for i, token in enumerate(tokens):
            word, known = token[1:], None
            if token[0] == "=":
                known = plain.get(word) if plain else None
            else:
                k = self.tokens.get("=" + word)
                if k is not None and k < base + i:
                    known = number[k - base] if k >= base else int(self.flat[self.first[k]]) & (1 << FEATURE_BITS) - 1
                else:
                    plain[word] = first + len(fresh)
            if known is None:
                known = first + len(fresh)
                fresh.append(zlib.crc32(word.encode(), _WORD_OPENED))
            number.append(known)
        self._describe(np.arange(self._new(len(fresh)), self.known), np.array(fresh, np.uint32), self.embedder.word_weight)
        return np.array(number, np.int64)

    def _learn(self, tokens: list[str]) -> None:
        """Numbers for new tokens and the features that they bring."""
        e, base = self.embedder, len(self.tokens) - len(tokens)
        low, high = e.ngram_range
        number, owner = [self._words(tokens, base)], [np.arange(len(tokens))]
        short = [i for i, t in enumerate(tokens) if t[0] == "=" and ord(max(t)) < _SHORT_CHARACTER] if len(self.table) else []
        if short:
            of, found = self._grams([tokens[i][1:] for i in short])
            owner.append(np.array(short)[of])
            number.append(found)
        if len(short) < len(tokens):
            one_by_one, names, held = set(short), [], []
            for i, token in enumerate(tokens):
                if token[0] == "=" and i not in one_by_one:
                    padded = f" {token[1:]} "
                    own = ["c:" + padded[k : k + n] for n in range(low, high + 1) for k in range(len(padded) - n + 1)]
                    names += own
                    held += [i] * len(own)
            owner.append(np.array(held, np.int64))
            number.append(self._named(names))
        owner, number = np.concatenate(owner), np.concatenate(number)
        width = np.bincount(owner, minlength=len(tokens))
        self.first, self.width, self.flat = _room(self.first, base + len(tokens)), _room(self.width, base + len(tokens)), _room(self.flat, self.used + len(number))
        self.first[base : base + len(tokens)], self.width[base : base + len(tokens)] = self.used + np.cumsum(width) - width, width
        if e.dim <= 1 << PLACE_BITS:
            number = self.bucket[number] << FEATURE_BITS + UNIT_BITS | number
        self.flat[self.used : self.used + len(number)] = number[np.argsort(owner.astype(np.uint16) if len(tokens) <= 1 << 16 else owner, kind="stable")]
        self.used += len(number)

    def _forget(self) -> None:
        if len(self.runs) > KNOWN_RUNS or len(self.tokens) > KNOWN_STEMS or self.known > KNOWN_FEATURES:
            self.clear()

    def _token_numbers(self, tokens: list[str]) -> np.ndarray:
        before = len(self.tokens)
        token = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        if len(self.tokens) > before:
            self._learn(_latest(self.tokens, before))
        return token

    def _learn_runs(self, runs: list[str]) -> None:
        """Features of new runs, which are those of their tokens one after another."""
        base = len(self.runs) - len(runs)
        found = iter(tagged([r for r in runs if r[0] != " "]))
        found = [["~" + r[1:]] if r[0] == " " else next(found) for r in runs]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        token = self._token_numbers(list(itertools.chain.from_iterable(found)))
        first, width = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        at = np.cumsum(sizes) - sizes
        one = sizes == 1
        first[one], width[one] = self.first[token[at[one]]], self.width[token[at[one]]]
        for k in np.flatnonzero(sizes > 1).tolist():
            own = token[at[k] : at[k] + sizes[k]]
            flat = np.concatenate([self.flat[a : a + n] for a, n in zip(self.first[own].tolist(), self.width[own].tolist(), strict=True)])
            self.flat = _room(self.flat, self.used + len(flat))
            self.flat[self.used : self.used + len(flat)] = flat
            first[k], width[k] = self.used, len(flat)
            self.used += len(flat)
        n = len(self.runs)
        self.run_first, self.run_width = _room(self.run_first, n), _room(self.run_width, n)
        self.run_first[base:n], self.run_width[base:n] = first, width

    def _run_numbers(self, split: list[list[str]], sizes: np.ndarray) -> np.ndarray:
        before = len(self.runs)
        run = np.fromiter(map(self.runs.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if len(self.runs) > before:
            self._learn_runs(_latest(self.runs, before))
        return run

    def numbered(self, texts: list[str], words: Runs) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """first and width of the features of each run of each text, and which texts have no stem, whose words count instead; where each
        text's runs start, and the end.  All this holds until the next call."""
        self._forget()
        # No word holds a dot or comma, and no rule looks across one: without them there are half as many runs to know.
        split = [t.split() for t in "\0".join(texts).replace(",", " ").replace(".", " ").split("\0")]
        if len(split) != len(texts):  # a text holds the mark
            split = [t.replace(",", " ").replace(".", " ").split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        run = self._run_numbers(split, sizes)
        held = np.bincount(np.repeat(np.arange(len(split)), sizes), self.run_width[run], len(split))
        bare = held == 0
        if bare.any():
            for k in np.flatnonzero(bare).tolist():
                split[k] = [" " + w for w in words.normal_words(texts[k])]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            run = self._run_numbers(split, sizes)
        return (self.run_first[run], self.run_width[run], bare), np.concatenate([[0], np.cumsum(sizes)])

    def of_tokens(self, units: list[list[str]]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """The same of units that are lists of tagged tokens."""
        self._forget()
        sizes = np.array([len(u) for u in units], np.int64)
        token = self._token_numbers(list(itertools.chain.from_iterable(units)))
        return (self.first[token], self.width[token], np.array([bool(u) and u[0][0] == "~" for u in units], bool)), np.concatenate([[0], np.cumsum(sizes)])

    def counted(self, numbers: tuple[np.ndarray, np.ndarray, np.ndarray], ends: np.ndarray, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """unit, feature and weighted count of each feature of each of the units from ``at`` on, whose runs are bounded by ``ends``; in the
        order of places in vectors and then units, if places are few enough."""
        lo, hi = int(ends[0]), int(ends[-1])
        first, every, bare, flat = numbers[0][lo:hi], numbers[1][lo:hi], numbers[2][at : at + len(ends) - 1], self.flat
        if not every.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        upto, found, lo = np.cumsum(every), [], 0
        while lo < len(first):  # as many units at once as have about CELLS features
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CELLS, "right")))
            hi = int(np.searchsorted(owner, owner[hi - 1], "right"))
            width = every[lo:hi]
            ends = np.cumsum(width)
            place = np.arange(ends[-1]) + np.repeat(first[lo:hi] - ends + width, width)
            key = np.repeat(owner[lo:hi] << FEATURE_BITS, width) | flat[place]
            key.sort()
            if len(key):
                at = _runs_of(key)
                found.append((key[at], np.concatenate([at[1:], [len(key)]]) - at))
            lo = hi
        key, times = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
        if len(found) > 1:
            order = np.argsort(key)
            key, times = key[order], times[order]
        unit, feature = key >> FEATURE_BITS & (1 << UNIT_BITS) - 1, key & (1 << FEATURE_BITS) - 1
        weight = self.weight[feature]
        return unit, feature, times * (np.where(bare[unit], 1.0, weight) if bare.any() else weight)

    def idf(self, feature: np.ndarray, n: int) -> np.ndarray:
        """Of each of a document's features, which are as many as its units hold them; n: units."""
        self.seen[feature] = 0
        np.add.at(self.seen, feature, 1)
        return (np.log((1 + n) / (1 + np.arange(n + 1))) + 1.0)[self.seen[feature]]


@dataclass(frozen=True)
class CallableEmbedder:
    """Any function from a list of texts to rows of numbers, called in batches."""

    fn: Callable[[list[str]], Sequence]
    batch_size: int = 64

    def rows(self, docs: Iterable[list[str]]) -> Iterable[np.ndarray]:
        for texts in docs:
            parts = [np.asarray(self.fn(list(texts[i : i + self.batch_size])), np.float64) for i in range(0, len(texts), self.batch_size)]
            yield _unit_rows(np.vstack(parts)) if parts else np.zeros((0, 1))


@dataclass(frozen=True)
class SentenceTransformerEmbedder:
    """A sentence-transformers model, loaded once per Python worker; e5 models get their passage prefix."""

    model_name: str
    prefix: str | None = None
    batch_size: int = 32
    device: str | None = None

    def rows(self, docs: Iterable[list[str]]) -> Iterable[np.ndarray]:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise ImportError("SentenceTransformerEmbedder needs the package sentence-transformers") from e
        model = SentenceTransformer(self.model_name, device=self.device)
        prefix = self.prefix if self.prefix is not None else "passage: " if "e5" in self.model_name.lower() else ""
        for texts in docs:
            yield np.asarray(model.encode([prefix + t for t in texts], batch_size=self.batch_size, normalize_embeddings=True, show_progress_bar=False), np.float64)


class MemoisingEmbedder:
    """Keeps each text's vector, so that a text has one vector whatever document it stands in.

    Vectors of an embedder that looks at a document as a whole, as the hashing one does, are those of the call in
    which a text was first seen.  Each Python task keeps its own; ``most`` texts at most are held.
    """

    def __init__(self, inner, most: int = 1 << 16) -> None:
        self.inner, self.most, self.known = inner, most, {}

    def rows(self, docs: Iterable[list[str]]) -> Iterable[np.ndarray]:
        known = self.known
        for texts in docs:
            if len(known) > self.most:
                known.clear()
            fresh = [t for t in dict.fromkeys(texts) if t not in known]
            if fresh:
                known.update(zip(fresh, next(iter(self.inner.rows([fresh]))), strict=True))
            yield np.vstack([known[t] for t in texts]) if texts else np.zeros((0, 1))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    norm[norm == 0] = 1
    return m / norm


def tokens_column(text: str = "text", compose: bool = True):
    """A unit's tagged tokens: its stems, or the words of its normalised text if it has no stem."""
    found = stems(text, compose)
    plain = F.regexp_extract_all(normalize_arabic(text, compose=compose), F.lit(f"{NOT_S}+"), F.lit(0))
    return F.when(F.size(found) > 0, F.transform(found, lambda w: F.concat(F.lit("="), w))).otherwise(F.transform(plain, lambda w: F.concat(F.lit("~"), w)))


def context_distance(v: np.ndarray, sections: np.ndarray, window: int) -> list[float | None]:
    """Cosine distance between the mean vectors of up to ``window`` units before and after each gap, none where sections meet."""
    out: list[float | None] = []
    opens = np.flatnonzero(np.concatenate([[True], sections[1:] != sections[:-1]])).tolist() if len(v) else []
    for a, b in zip(opens, [*opens[1:], len(v)], strict=True):
        for lo in range(a, b - 1, GAPS):
            m = min(GAPS, b - 1 - lo)
            # Rows from the first gap's window to the last one's, with rows of 0 beyond the section.
            below, above = max(a, lo - window + 1), min(b, lo + m + window)
            rows = np.zeros((m + 2 * window - 1, v.shape[1]))
            rows[below - (lo - window + 1) :][: above - below] = v[below:above]
            sums = rows[: m + window].copy()
            for k in range(1, window):
                sums += rows[k : k + m + window]
            norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            norm = norm[:m] * norm[window:]
            cos = np.einsum("ij,ij->i", sums[:m], sums[window:]) / np.where(norm == 0, 1, norm)
            out += np.where(norm > 0, 1.0 - cos, 1.0).tolist()
        if b < len(v):
            out.append(None)
    return out


def document_rows(units: DataFrame, *columns) -> DataFrame:
    """doc_id, units: one row per document, its units in order with ``columns`` and their texts."""
    own = units.select("doc_id", F.struct("section_idx", "start", *columns, "text").alias("u"))
    return own.groupBy("doc_id").agg(F.array_sort(F.collect_list("u")).alias("units"))


def gap_distances(units: DataFrame, embedder=HashingEmbedder(), window: int = 3, keep_vectors: bool = True) -> DataFrame:
    """doc_id, unit_idx, dist (of the gap behind the unit; null at section ends and the last unit), vector of every unit.

    vector: the unit's row as bytes of 64-bit indices below 2**16 and values, only what is not 0.
    """
    rows = document_rows(units)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in bounded(batches):
            docs = batch.column(1).to_pylist()
            for k, m in enumerate(embedder.rows([[u["text"] for u in d] for d in docs])):
                dist = [*context_distance(m, np.array([u["section_idx"] for u in docs[k]]), window), None]
                data = [pack_row(r) for r in m] if keep_vectors else [None] * len(m)
                yield pa.record_batch([batch.column(0).take(pa.array([k] * len(m), pa.int64())), pa.array(range(len(m)), pa.int32()), pa.array(dist, pa.float64()), pa.array(data, pa.binary())], names=["doc_id", "unit_idx", "dist", "vector"])

    return rows.mapInArrow(run, f"doc_id {kind}, unit_idx int, dist double, vector binary")


def pack_row(row: np.ndarray) -> bytes:
    at = np.flatnonzero(row)
    return at.astype("<u4").tobytes() + row[at].astype("<f8").tobytes()


def unpack_row(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, "<f8", n, 4 * n)


# The same vectors in DataFrame operations, a row per feature.


def features(units: DataFrame, embedder: HashingEmbedder = HashingEmbedder()) -> DataFrame:
    """doc_id, unit_idx, feature, tf: weighted counts of stems ("w:...") and of their n-grams ("c:...")."""
    lo, hi = embedder.ngram_range
    token = units.select("doc_id", "unit_idx", F.explode(tokens_column()).alias("t")).groupBy("doc_id", "unit_idx", "t").agg(F.count(F.lit(1)).alias("n"))
    word = F.substring("t", F.lit(2), F.length("t"))
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    grams = F.flatten(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.when(F.length(padded) >= k, F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.struct(F.concat(F.lit("c:"), F.substring(padded, i, k)).alias("feature"), F.lit(1.0).alias("w")))).otherwise(F.array().cast("array<struct<feature:string,w:double>>"))))
    stem = F.col("t").startswith("=")
    whole = F.array(F.struct(F.concat(F.lit("w:"), word).alias("feature"), F.when(stem, F.lit(embedder.word_weight)).otherwise(F.lit(1.0)).alias("w")))
    out = token.select("doc_id", "unit_idx", "n", F.explode(F.when(stem, F.concat(whole, grams)).otherwise(whole)).alias("f"))
    return out.groupBy("doc_id", "unit_idx", "f.feature").agg(F.sum(F.col("f.w") * F.col("n")).alias("tf"))


def idf(feats: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, feature, df, idf over all units of each document."""
    n = units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"))
    df = feats.groupBy("doc_id", "feature").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "doc_id").select("doc_id", "feature", "df", F.when(F.col("n_units") > 1, F.log((1 + F.col("n_units")) / (1 + F.col("df"))) + 1).otherwise(F.lit(1.0)).alias("idf"))


def hashed_vectors(units: DataFrame, embedder: HashingEmbedder = HashingEmbedder()) -> DataFrame:
    """doc_id, unit_idx, bucket, w: the non-zero places of each unit's vector of length 1."""
    feats = features(units, embedder)
    weighed = feats.join(idf(feats, units), ["doc_id", "feature"]) if embedder.use_idf else feats.withColumn("idf", F.lit(1.0))
    crc = F.crc32(F.encode("feature", "UTF-8"))
    value = F.when(F.shiftright(crc, 31) == 1, 1.0).otherwise(-1.0) * (1 + F.log("tf")) * F.col("idf")
    out = weighed.select("doc_id", "unit_idx", (crc % embedder.dim).cast("int").alias("bucket"), value.alias("x")).groupBy("doc_id", "unit_idx", "bucket").agg(F.sum("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("doc_id", "unit_idx")))
    return out.select("doc_id", "unit_idx", "bucket", (F.col("x") / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))).alias("w"))
