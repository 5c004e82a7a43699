"""Sections, sentences and units once more for Python workers, a whole document at a time.

A document's units depend on nothing outside it, so a worker that has its text needs neither windows nor exchanges.
Results are those of ``structure.sections``, ``sentences.sentences`` and ``sentences.units``; tests hold the two against
each other.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from maqta.functions import lexicon as L
from maqta.functions import text as X
from maqta.functions.words import own
from maqta.operators import sentences as B
from maqta.operators.sentences import WORDS, Length, cut_places
from maqta.operators.vectors import bounded

#: Runs before a dot whose kind is kept at most.
KNOWN = 100_000


class Unit(NamedTuple):
    section_idx: int
    start: int
    end: int
    text: str
    paragraph_start: bool
    tokens: int
    headings: list[str]


_MARKDOWN, _BOLD, _TITLE, _DECIMAL, _REVERSED = map(own, (X._MARKDOWN, X._BOLD, X._TITLE, X._DECIMAL, X._REVERSED))
_LEGAL = [(level, own(X._legal(level))) for level in sorted(L.LEGAL_KEYWORDS)]
_DOTS = re.compile(r"[^.]+")


def heading_of(line: str) -> tuple[str, int] | None:
    """Heading and level of a line that is a heading."""
    t = line.strip()
    if not t:
        return None
    if t[0] == "#" and (m := _MARKDOWN.match(t)):
        return m[2].strip("* "), len(m[1])
    if len(t) > L.HEADING_CHARS:
        return None
    if "ء" <= t[0] <= "ي":
        for level, pattern in _LEGAL:
            if pattern.match(t):
                return t.rstrip(":：-–— "), level
    if t[0] == "(" and _REVERSED.match(t):
        return t.rstrip(":：-–— "), 4
    if t[0] == "*" and (m := _BOLD.match(t)):
        return m[1].strip(), 2
    if _TITLE.match(t):
        return t.rstrip(": "), 2
    if (m := _DECIMAL.match(t)) and len(m[2].split()) <= L.NUMBERED_WORDS and t[-1] not in ".!?؟،,؛":
        return t, min(len(_DOTS.findall(m[1])), 6)
    return None


def sections_of(text: str, respect_structure: bool) -> Iterator[tuple[int, str, list[str]]]:
    """start, body and headings of the sections that are not white space alone."""
    if not respect_structure:
        if text.strip():
            yield 0, text, []
        return
    path: dict[int, str] = {}
    first = at = 0
    for line in [*text.splitlines(keepends=True), None]:
        found = heading_of(line) if line is not None else None
        if line is None or found:
            body = text[first:at]
            if body.strip():
                yield first, body, [path[n] for n in sorted(path)]
        if found:
            path = {n: h for n, h in path.items() if n < found[1]} | {found[1]: found[0]}
            first = at + len(line)
        at += len(line or "")


_PARAGRAPH, _MARKER = re.compile(B.PARAGRAPH), own(X.LIST_MARKER)
_ENDS = frozenset(L.LINE_END[1:-1].replace("\\", ""))


def groups_of(body: str) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """For each paragraph the groups of lines that only wrap, as start and text."""
    at = 0
    for m in [*_PARAGRAPH.finditer(body), None]:
        para, start = body[at : m.start() if m else len(body)], at
        groups, opened, place, previous = [], 0, 0, None
        for line in para.split("\n") if "\n" in para else ():
            if previous is not None:
                bare = previous.rstrip()
                if not bare or bare[-1] in _ENDS or _MARKER.match(line):
                    groups.append((start + opened, para[opened : place - 1]))
                    opened = place
            place += len(line) + 1
            previous = line
        groups.append((start + opened, para[opened:]))
        yield groups
        at = m.end() if m else at


_TERMINATOR, _WORD = own(B.TERMINATOR), own(L.WORD)
_AND_SO_ON, _ERA, _YEAR_ERA, _NUMBER = map(own, (B._AND_SO_ON, B._ERA, B._YEAR_ERA, B._NUMBER))
#: Python has no class for letters alone; what the group holds is looked at.
_SHORT = own(B._SHORT.replace(r"\p{L}", r"([^\W\d_])"))
_ALONE, _DIGITS = re.compile(r"\s*\d+\s*\Z"), re.compile(r"\d+")


def _kind(run: str) -> int:
    """What a run of characters before a dot is: "and so on" 1, an era 2, an abbreviation or initials 3, a number 4, else 0."""
    if _AND_SO_ON.search(run):
        return 1
    if _ERA.search(run):
        return 2
    short = _SHORT.search(run)
    if short and (short[1] is None or short[1].isalpha()):
        return 3
    return 4 if _NUMBER.search(run) else 0


#: Which characters are in words, and which a sentence's end may start with; the last place stands for all from there on, which are neither.
_BASIC = "".join(map(chr, range(0xFFFF)))
_IN_WORD, _MAY_END = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
for _m in _WORD.finditer(_BASIC):
    _IN_WORD[_m.start() : _m.end()] = True
_MAY_END[[ord(c) for c in re.findall(L.TERMINATOR_RUN, _BASIC) for c in c]] = True


def _words_within(inside: np.ndarray, starts: list[int], ends: list[int]) -> list[int]:
    """How many words each range of a text has; inside: which of its characters are in words."""
    upto = np.concatenate([[0], np.cumsum(inside[1:] & ~inside[:-1])])
    first, last = np.array(starts), np.array(ends)
    return (upto[last - 1] - upto[first] + inside[first]).tolist()


class Sentences:
    """Sentences of bodies; kinds of runs before dots are kept."""

    def __init__(self) -> None:
        self.kinds: dict[str, int] = {}

    def protected(self, text: str, dot: int) -> bool:
        """Whether a dot belongs to an abbreviation, initials or a list number."""
        near = text[max(0, dot - B.LOOK_BACK) : dot]
        parts = near.rsplit(None, 1)
        if not parts:
            return True
        run = parts[-1]
        kind = self.kinds.get(run)
        if kind is None:
            if len(self.kinds) > KNOWN:
                self.kinds.clear()
            kind = self.kinds[run] = _kind(run)
        if kind == 1:
            tail = text[dot + 1 : dot + 1 + B.LOOK_AHEAD].lstrip()
            return bool(tail) and unicodedata.category(tail[0]) == "Ll"
        if kind == 2:
            return not _YEAR_ERA.search(near)
        if kind == 4:
            line = text[max(0, dot - B.LINE_BACK) : dot].rpartition("\n")[2]
            return bool(_ALONE.match(line)) and len(_DIGITS.sub("", line)) <= 8
        return kind == 3

    def of(self, body: str, first: int, marks: list[int]) -> Iterator[tuple[int, str, bool]]:
        """start, text and whether it opens a paragraph of each sentence of a section's body, which starts at ``first``; marks: the
        places in the text where a sentence's end may start."""
        k, match = bisect_left(marks, first), _TERMINATOR.match
        marks = [*marks[k : bisect_left(marks, first + len(body), k)], first + len(body)]
        k = 0
        for groups in groups_of(body):
            opens = True
            for base, text in groups:
                at, upto, low, whole = 0, 0, first + base, len(text)
                while at < whole:
                    dot, end = marks[k] - low, whole
                    if dot < whole:
                        k += 1
                        if dot < upto or not (m := match(text, dot)):
                            continue
                        upto = end = m.end()
                        if text[dot] == "." and not text.startswith("...", dot) and self.protected(text, dot):
                            continue
                    raw = text[at:end]
                    lead = raw.lstrip()
                    if lead:
                        yield base + end - len(lead), lead.rstrip(), opens
                        opens = False
                    at = end

    def units(self, text: str, max_tokens: int, respect_structure: bool, length: Length) -> list[Unit]:
        out, of = [], length.of
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
        marks = np.flatnonzero(_MAY_END[codes]).tolist()
        spans, headings_of = [], []
        for k, (first, body, headings) in enumerate(sections_of(text, respect_structure)):
            headings_of.append(headings)
            spans += [(k, first + at, own_text, opens) for at, own_text, opens in self.of(body, first, marks)]
        if length is WORDS and spans:
            counts = _words_within(_IN_WORD[codes], [s[1] for s in spans], [s[1] + len(s[2]) for s in spans])
        else:
            counts = [of(s[2]) for s in spans]
        for (k, start, own_text, opens), n in zip(spans, counts, strict=True):
            headings = headings_of[k]
            if n <= max_tokens:
                out.append(Unit(k, start, start + len(own_text), own_text, opens, n, headings))
                continue
            for i, (a, b) in enumerate(cut_places(own_text, max_tokens, length)):
                part = own_text[a:b]
                out.append(Unit(k, start + a, start + b, part, opens and i == 0, of(part), headings))
        return out


def documents(batches: Iterable[pa.RecordBatch], max_tokens: int, respect_structure: bool, length: Length) -> Iterator[tuple[object, str, list[Unit]]]:
    """doc_id, text and units of the documents (doc_id, text) that have a unit."""
    found = Sentences()
    for batch in bounded(batches):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            units = found.units(text or "", max_tokens, respect_structure, length)
            if units:
                yield key, text, units


def embedded(docs: Iterable[tuple[object, str, list[Unit]]], rows: Callable[[Iterable[list[str]]], Iterable]) -> Iterator[tuple]:
    """The documents with what ``rows`` of an embedder makes of their units; one call for all, so it may keep what it knows."""
    waiting: deque = deque()

    def texts() -> Iterator[list[str]]:
        for d in docs:
            waiting.append(d)
            yield [u.text for u in d[2]]

    for m in rows(texts()):
        yield *waiting.popleft(), m
