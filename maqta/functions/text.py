"""Text functions on columns: normalisation, words, stems, cues and headings.

All are Spark SQL expressions.  The one exception is NFKC, for which Spark has no function: rows whose
characters it could change go through a vectorised function, all others never leave the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maqta.functions import lexicon as L

S, NOT_S = f"[{L.SPACE}]", f"[^{L.SPACE}]"

#: A character that NFKC may change.  What it leaves alone here: ASCII, letters of Latin-1 and Latin Extended-A, Arabic
#: letters and marks, dashes, quotes, and controls that are dropped anyway.
_MAY_CHANGE = (
    r"[^\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    r"\u0600-\u0652\u0656-\u0674\u0679-\u06ff\u2010\u2012-\u2016\u2018-\u2023" + L.CONTROLS + "]"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column | str) -> Column:
    """Compatibility composition; only rows that it may change reach Python with a text."""
    c = _col(c)
    odd = F.coalesce(c.rlike(_MAY_CHANGE), F.lit(False))
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), F.lit(rf"\A{S}+|{S}+\z"), F.lit(""))


def strip_diacritics(c: Column | str) -> Column:
    """Without vowel marks, Quranic marks and tatweel."""
    return F.regexp_replace(_col(c), F.lit(f"[{L.DIACRITICS}]"), F.lit(""))


def normalize_arabic(c: Column | str, *, fold_letters: bool = True, latin_digits: bool = True, lowercase: bool = True, compose: bool = True) -> Column:
    """Text for matching: composed, without marks and controls, letters and digits folded, scripts set apart by a
    blank, lower case, single blanks.  Null is empty.  ``compose=False`` leaves NFKC out."""
    t = F.coalesce(_col(c), F.lit(""))
    t = nfkc(t) if compose else t
    t = F.regexp_replace(t, F.lit(f"[{L.CONTROLS}{L.DIACRITICS}]"), F.lit(""))
    source, target = (L.FOLD_FROM if fold_letters else "") + (L.DIGITS_FROM if latin_digits else ""), (L.FOLD_TO if fold_letters else "") + (L.DIGITS_TO if latin_digits else "")
    t = F.translate(t, source, target) if source else t
    t = F.regexp_replace(t, F.lit(f"(?<=[{L.ARABIC}])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[{L.ARABIC}])"), F.lit(" "))
    t = F.lower(t) if lowercase else t
    return F.trim(F.regexp_replace(t, F.lit(f"{S}+"), F.lit(" ")))


def is_arabic(c: Column | str, threshold: float = 0.3) -> Column:
    """Whether Arabic letters are at least ``threshold`` of all letters; without letters false."""
    c = F.coalesce(_col(c), F.lit(""))
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    arabic = F.regexp_count(c, F.lit(rf"[{L.ARABIC}&&\p{{L}}]"))
    return F.when(letters == 0, F.lit(False)).otherwise(arabic >= F.lit(threshold) * letters)


def words(c: Column | str) -> Column:
    """Surface words, as they stand."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(L.WORD), F.lit(0))


def count_words(c: Column | str) -> Column:
    """Number of surface words: the default length of a text."""
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(L.WORD))


_PREFIX = f"(?s)^(?:{'|'.join(L.PREFIXES)})(?=.{{3}})"
_SUFFIX = rf"(?s)^(.{{3,}}?)(?:{'|'.join(L.SUFFIXES)})\z"


def light_stem(c: Column | str) -> Column:
    """A normalised word without one prefix and one suffix, three letters at least; words without an Arabic letter as they are."""
    c = _col(c)
    cut = F.regexp_replace(F.regexp_replace(c, F.lit(_PREFIX), F.lit("")), F.lit(_SUFFIX), F.lit("$1"))
    return F.when(c.rlike(f"[{L.ARABIC}]"), cut).otherwise(c)


def _plain(text: str) -> str:
    """What normalize_arabic makes of a constant of the lexicon, on the driver."""
    t = unicodedata.normalize("NFKC", text).translate(str.maketrans(L.FOLD_FROM + L.DIGITS_FROM, L.FOLD_TO + L.DIGITS_TO))
    return " ".join("".join(ch for ch in t if not unicodedata.combining(ch) and ch != "ـ").lower().split())


STOP = sorted({_plain(w) for w in L.STOPWORDS})


def stems(c: Column | str, compose: bool = True) -> Column:
    """Stems of the words that carry a topic, in order, repeats included."""
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), F.lit(rf"(?:اً|ًا)(?![{L.ARABIC}])"), F.lit(""))
    found = words(normalize_arabic(t, compose=compose))
    return F.transform(F.filter(found, lambda w: ~w.isin(STOP)), light_stem)


def _opening(phrases: Iterable[str]) -> str:
    longest_first = sorted({_plain(p) for p in phrases}, key=len, reverse=True)
    return rf"\A(?:{'|'.join(longest_first)})(?:{S}|\z|،|,)"


_SHIFT, _CONTINUE = _opening(L.SHIFT), _opening(L.CONTINUE)
LIST_ITEM = rf"\A{S}*(?:[{L.ITEM_BULLETS}]|\(?{L.DIGIT}{{1,3}}[.)\-]|\(?[{L.ARABIC}][)\-])"
LIST_MARKER = rf"\A{S}*(?:[{L.LIST_BULLETS}]|\(?{L.DIGIT}{{1,3}}[.)\-–]|\(?[{L.ARABIC}][)\-–]|(?:{'|'.join(L.LIST_ORDINALS)}))"


def discourse_bias(c: Column | str, weight: float = 1.0, compose: bool = True) -> Column:
    """How much a sentence's opening speaks for a break before it: list items -w/2, topic openings w, connectives -w, others 0."""
    c = F.coalesce(_col(c), F.lit(""))
    head = F.substring(normalize_arabic(c, compose=compose), 1, 40)
    return F.when(c.rlike(LIST_ITEM), F.lit(-0.5 * weight)).when(head.rlike(_SHIFT), F.lit(float(weight))).when(head.rlike(_CONTINUE), F.lit(-float(weight))).otherwise(F.lit(0.0))


def _spaced(words_: Iterable[str]) -> str:
    return "|".join(w.replace(" ", f"{S}+") for w in words_)


_NUMBER = rf"(?:\(?{S}*[0-9{L.ARABIC_DIGITS}]+{S}*\)?|{_spaced(L.ORDINALS)}|[{L.ARABIC}]+{S}+(?:{'|'.join(L.COMPOUND_ORDINAL_ENDS)}))"
_MARKDOWN = rf"\A(#{{1,6}}){S}+(.+?){S}*#*{S}*\z"
_BOLD = rf"\A\*\*(.+?)\*\*{S}*:?{S}*\z"
_TITLE = rf"(?iu)\A(?:{_spaced(L.STANDALONE_TITLES)}){S}*:?{S}*\z"
_DECIMAL = rf"\A((?:[0-9{L.ARABIC_DIGITS}]+\.)+[0-9{L.ARABIC_DIGITS}]*){S}+({NOT_S}.*)\z"
_REVERSED = rf"\A\({S}*[0-9{L.ARABIC_DIGITS}]+{S}*\){S}*(?:ال)?مادة\z"


def _legal(level: int) -> str:
    return rf"\A(?:{L.LEGAL_KEYWORDS[level]}){S}*{_NUMBER}(?:{S}*[:：\-–—.]{S}*.*)?{S}*\z"


def detect_heading(c: Column | str) -> Column:
    """struct(heading, level) of a line that is a heading, else null."""
    t = strip(F.coalesce(_col(c), F.lit("")))
    bare = lambda x, chars, ends=r"\A[{0}]+|[{0}]+\z": F.regexp_replace(x, F.lit(ends.format(chars)), F.lit(""))
    right = r"[{0}]+\z"
    made = lambda text, level: F.struct(text.alias("heading"), (F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"))
    hashes, number, rest = F.regexp_extract(t, _MARKDOWN, 1), F.regexp_extract(t, _DECIMAL, 1), F.regexp_extract(t, _DECIMAL, 2)
    depth = F.least(F.regexp_count(number, F.lit(r"[^.]+")), F.lit(6))
    short = (F.regexp_count(rest, F.lit(f"{NOT_S}+")) <= L.NUMBERED_WORDS) & ~t.rlike(rf"[.!?؟،,؛]{S}*\z")
    out = F.when(t == "", None).when(hashes != "", made(bare(F.regexp_extract(t, _MARKDOWN, 2), "* "), F.length(hashes)))
    out = out.when(F.length(t) > L.HEADING_CHARS, None)
    for level in sorted(L.LEGAL_KEYWORDS):
        out = out.when(t.rlike(_legal(level)), made(bare(t, r":：\-–— ", right), level))
    out = out.when(t.rlike(_REVERSED), made(bare(t, r":：\-–— ", right), 4))
    out = out.when(t.rlike(_BOLD), made(strip(F.regexp_extract(t, _BOLD, 1)), 2))
    out = out.when(t.rlike(_TITLE), made(bare(t, ": ", right), 2))
    return out.when((number != "") & short, made(t, depth))
