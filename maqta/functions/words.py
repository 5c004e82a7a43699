"""The text functions once more for Python workers, run by run of characters without white space.

Normalisation and stemming never look across white space, so a run's result holds wherever it stands and is
kept: a worker works out each distinct run once, where the column expressions work on every character.  Results are
those of ``normalize_arabic``, ``stems`` and ``discourse_bias``; tests hold the two against each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

from maqta.functions import lexicon as L
from maqta.functions import text as X

#: Runs that are kept at most.
KNOWN = 200_000
_DROP = re.compile(f"[{L.CONTROLS}{L.DIACRITICS}]")
_ODD = re.compile(f"[{L.CONTROLS}{L.DIACRITICS}{L.FOLD_FROM}{L.DIGITS_FROM}]")
_FOLD = str.maketrans(L.FOLD_FROM + L.DIGITS_FROM, L.FOLD_TO + L.DIGITS_TO)
_MEET = re.compile(f"(?<=[{L.ARABIC}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{L.ARABIC}])")
_PLAIN = re.compile("[A-Za-z0-9]")
_TANWEEN = re.compile(rf"(?:اً|ًا)(?![{L.ARABIC}])")
_WORD, _ARABIC = re.compile(L.WORD), re.compile(f"[{L.ARABIC}]")


def own(pattern: str) -> re.Pattern:
    """A pattern of the column expressions in Python's spelling."""
    return re.compile(pattern.replace(r"\z", r"\Z").replace(r"\p{Nd}", r"\d"))


#: Affixes by length, the longest first: the lists hold no affix before a longer one that it could hide.
_BY_LENGTH = tuple([(n, frozenset(a for a in affixes if len(a) == n)) for n in (4, 3, 2, 1)] for affixes in (L.PREFIXES, L.SUFFIXES))
_FIRST_OF, _LAST_OF = frozenset(a[0] for a in L.PREFIXES), frozenset(a[-1] for a in L.SUFFIXES)
_SHIFT, _CONTINUE, _ITEM = own(X._SHIFT), own(X._CONTINUE), own(X.LIST_ITEM)
_STOP = frozenset(X.STOP)
#: What an opening starts with, up to a blank or comma: nothing else needs a look at the openings.
_FIRST = frozenset(re.split("[ ،,]", X._plain(p))[0] for p in (*L.SHIFT, *L.CONTINUE))
_CUT = re.compile("[،,]")


def normal(run: str) -> list[str]:
    """The words, by white space, of a normalised run."""
    t = unicodedata.normalize("NFKC", run)
    if _ODD.search(t):
        t = _DROP.sub("", t).translate(_FOLD)
    t = _MEET.sub(" ", t) if _PLAIN.search(t) and not t.isascii() else t
    return t.lower().split()


def stem(word: str) -> str:
    if not _ARABIC.search(word):
        return word
    for n, prefixes in _BY_LENGTH[0] if word[0] in _FIRST_OF else ():
        if word[:n] in prefixes and len(word) >= n + 3:
            word = word[n:]
            break
    for n, suffixes in _BY_LENGTH[1] if word[-1] in _LAST_OF else ():
        if word[-n:] in suffixes and len(word) >= n + 3:
            return word[:-n]
    return word


def tagged(runs: list[str]) -> list[list[str]]:
    """The tagged stems of each run.  Nothing looks across line feeds, so many runs are normalised as one text."""
    t = unicodedata.normalize("NFKC", _TANWEEN.sub("", "\n".join(runs)))
    if _ODD.search(t):
        t = _DROP.sub("", t).translate(_FOLD)
    t = _MEET.sub(" ", t) if not t.isascii() else t
    return [["=" + stem(w) for w in _WORD.findall(line) if w not in _STOP] for line in t.lower().split("\n")]


class _Stems(dict):
    """Tagged stems of runs, worked out when first asked for."""

    def __missing__(self, run: str) -> list[str]:
        self[run] = found = tagged([run])[0]
        return found


class Runs:
    """Normal forms and stems of runs seen by this worker."""

    def __init__(self) -> None:
        self.normal: dict[str, list[str]] = {}
        self.stems = _Stems()
        #: Whether a run, at the start of a unit, rules an opening out.
        self.silent: dict[str, bool] = {}

    def normal_words(self, text: str) -> Iterator[str]:
        if len(self.normal) > KNOWN:
            self.normal.clear()
        for run in text.split():
            found = self.normal.get(run)
            if found is None:
                found = self.normal[run] = normal(run)
            yield from found

    def stems_of(self, text: str) -> list[str]:
        return [t[1:] for t in self._tagged(text)]

    def _tagged(self, text: str) -> list[str]:
        if len(self.stems) > KNOWN:
            self.stems.clear()
        return list(chain.from_iterable(map(self.stems.__getitem__, text.split())))

    def tokens(self, text: str) -> list[str]:
        """A unit's tagged tokens: its stems ("=x"), or the words of its normalised text ("~x") if it has no stem."""
        return self._tagged(text) or ["~" + w for w in self.normal_words(text)]

    def discourse_bias(self, text: str, weight: float) -> float:
        """How much a unit's opening speaks for a break before it."""
        if _ITEM.match(text):
            return -0.5 * weight
        run = text.split(None, 1)[:1]
        if run and self._silent(run[0]):
            return 0.0
        head = ""
        for w in self.normal_words(text):
            if not head and _CUT.split(w, maxsplit=1)[0] not in _FIRST:
                return 0.0
            head = f"{head} {w}" if head else w
            if len(head) >= 40:
                break
        head = head[:40]
        return weight if _SHIFT.match(head) else -weight if _CONTINUE.match(head) else 0.0

    def _silent(self, run: str) -> bool:
        found = self.silent.get(run)
        if found is None:
            if len(self.silent) > KNOWN:
                self.silent.clear()
            words = normal(run)
            found = self.silent[run] = bool(words) and _CUT.split(words[0], maxsplit=1)[0] not in _FIRST
        return found
