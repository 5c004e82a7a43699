"""Sentences, clauses and units, with exact code-point offsets.

Cutting works with marks: a regular expression puts a character that no text holds behind (or around) each
place of interest, the text is split there, and lengths are summed up to offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maqta.functions import lexicon as L
from maqta.functions.text import LIST_MARKER, NOT_S, S, count_words, strip
from maqta.operators.structure import sections

#: Noncharacters that mark cuts; where a text holds one, a replacement stands in for it while cuts are sought.
MARK, MARK2 = "\ufffe", "\uffff"
PARAGRAPH = rf"\n[ \t\xa0]*\n{S}*"
TERMINATOR = rf"{L.TERMINATOR_RUN}{L.CLOSERS}(?={S}|\z|[{L.ARABIC}])"
LOOK_BACK, LOOK_AHEAD, LINE_BACK = 80, 15, 100
#: The look at the next character comes first, so that looking back costs nothing elsewhere.  Where the first group
#: matches, the second may still hold what it matched at an earlier dot that ends nothing.
_HEAD = rf"(?s)(?=[.…!?؟])(?:(?<=(.{{{LINE_BACK}}}))|(?<=\A(.{{0,{LINE_BACK - 1}}})))"
CONNECTIVE = rf"{S}(?=[وف]?(?:{'|'.join(c.replace(' ', S + '+') for c in L.CONNECTIVES)}){S})"


def _safe(text: Column) -> Column:
    return F.translate(text, MARK + MARK2, "\ufffd\ufffd")


def _lead(text: Column) -> Column:
    """Characters of white space at the start."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(rf"\A{S}+"), F.lit("")))


def _narrow(text: Column) -> Column:
    """Characters beyond 16 bits as others of their kind: looking back, Java's patterns count the latter alone rightly."""
    wide, out = r"\x{10000}-\x{10ffff}", text
    for kind, other in ((r"&&\p{L}", "一"), (rf"&&{L.DIGIT}", "0"), ("", "\ufffd")):
        out = F.regexp_replace(out, F.lit(f"[{wide}{kind}]"), F.lit(other))
    return F.when(text.rlike(f"[{wide}]"), out).otherwise(text)


def paragraphs(secs: DataFrame) -> DataFrame:
    """doc_id, section_idx, para_idx, start, text of sections (doc_id, section_idx, start, body)."""
    marked = F.regexp_replace(_safe(F.col("body")), F.lit(f"({PARAGRAPH})"), F.lit(f"{MARK}$1{MARK2}"))
    path = [c for c in secs.columns if c == "headings"]
    cut = secs.select("doc_id", "section_idx", *path, F.col("start").alias("base"), F.posexplode(F.split(marked, f"[{MARK}{MARK2}]", -1)).alias("i", "text"))
    before = W.partitionBy("doc_id", "section_idx").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("start", F.col("base") + F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    return cut.where("i % 2 = 0").select("doc_id", "section_idx", *path, (F.col("i") / 2).cast("int").alias("para_idx"), F.col("start").cast("int").alias("start"), "text")


def line_groups(paras: DataFrame) -> DataFrame:
    """doc_id, section_idx, para_idx, group_idx, start, text: lines that only wrap stay together.

    A group ends after a line that is finished or blank, and before a list item.
    """
    path = [c for c in paras.columns if c == "headings"]
    cut = paras.select("doc_id", "section_idx", *path, "para_idx", F.col("start").alias("base"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    by_para = W.partitionBy("doc_id", "section_idx", "para_idx").orderBy("i")
    previous = F.lag("line").over(by_para)
    ends = previous.rlike(rf"{L.LINE_END}{S}*\z") | (strip(previous) == "") | F.col("line").rlike(LIST_MARKER)
    cut = cut.withColumn("opens", F.coalesce(ends & previous.isNotNull(), F.lit(False)).cast("int"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(by_para.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("group_idx", F.sum("opens").over(by_para)).withColumn("start", F.col("base") + before)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return cut.groupBy("doc_id", "section_idx", "para_idx", "group_idx").agg(F.min("start").cast("int").alias("start"), text.alias("text"), *(F.first(c).alias(c) for c in path))


_OPEN, _CLOSE = rf"(?:\A|{S})[(«\"'\[]*", rf"ـ*{S}*\z"


def _one_of(words: list[str]) -> str:
    """Tokens of a list as a pattern; tatweel at a token's end does not count."""
    return "|".join(sorted({w.rstrip("ـ").replace(".", r"\.") for w in words}, key=len, reverse=True))


_NOTHING = rf"\A{S}*\z"
_AND_SO_ON = rf"(?iu){_OPEN}(?:{_one_of(L.AND_SO_ON)}){_CLOSE}"
_ERA = rf"(?iu){_OPEN}(?:{_one_of(L.ERAS)}){_CLOSE}"
_YEAR_ERA = rf"(?iu)(?:\A|{S}){L.DIGIT}+{S}+[(«\"'\[]*(?:{_one_of(L.ERAS)}){_CLOSE}"
_SHORT = rf"(?u){_OPEN}(?:(?i:{_one_of(L.ABBREVIATIONS)})|\p{{L}}|(?:[A-Za-z]\.)+[A-Za-z]?){_CLOSE}"
_NUMBER = rf"{_OPEN}({L.DIGIT}+){_CLOSE}"


def _protected(head: Column, tail: Column) -> Column:
    """Whether a dot belongs to an abbreviation, initials or a list number.

    head: up to 100 characters before it, within its group of lines; tail: up to 15 after it.  What counts is the
    run of characters before the dot, without opening marks, of which 80 characters are looked at.
    """
    near = F.right(head, F.lit(LOOK_BACK))
    line = F.regexp_extract(head, r"([^\n]*)\z", 1)
    alone = line.rlike(rf"\A{S}*{L.DIGIT}+{S}*\z") & (F.length(F.regexp_replace(line, F.lit(f"{L.DIGIT}+"), F.lit(""))) <= 8)
    return (
        F.when(near.rlike(_NOTHING), True)
        .when(near.rlike(_AND_SO_ON), tail.rlike(rf"\A{S}*\p{{Ll}}"))
        .when(near.rlike(_ERA), ~near.rlike(_YEAR_ERA))
        .when(near.rlike(_SHORT), True)
        .when(near.rlike(_NUMBER), alone)
        .otherwise(False)
    )


def sentences(secs: DataFrame) -> DataFrame:
    """doc_id, section_idx, start, end, text, paragraph_start of sections (doc_id, section_idx, start, body), and their headings.

    paragraph_start marks the first sentence of each paragraph.
    """
    groups = line_groups(paragraphs(secs))
    all_of = lambda pattern, n: F.regexp_extract_all("text", F.lit(pattern), F.lit(n))
    parts = groups.withColumn("pieces", F.split("text", TERMINATOR, -1)).withColumn("marks", all_of(f"({TERMINATOR})", 1))
    heads = [F.regexp_extract_all(_narrow(F.col("text")), F.lit(_HEAD + TERMINATOR), F.lit(n)) for n in (1, 2)]
    parts = parts.withColumn("heads", F.zip_with(*heads, lambda a, b: F.when(a != "", a).otherwise(b)))
    parts = parts.withColumn("tails", all_of(rf"(?s)(?=[.…!?؟](.{{0,{LOOK_AHEAD}}})){TERMINATOR}", 1))
    ended = F.transform(F.arrays_zip("marks", "heads", "tails"), lambda x: F.when(x["marks"].startswith(".") & ~x["marks"].startswith("...") & _protected(x["heads"], x["tails"]), x["marks"]).otherwise(F.concat(x["marks"], F.lit(MARK))))
    joined = F.array_join(F.transform(F.arrays_zip(F.col("pieces").alias("p"), F.concat(ended, F.array(F.lit(""))).alias("m")), lambda x: F.concat(x["p"], x["m"])), "")
    path = [c for c in secs.columns if c == "headings"]
    cut = parts.select("doc_id", "section_idx", *path, "para_idx", "group_idx", F.col("start").alias("base"), F.posexplode(F.split(joined, MARK, -1)).alias("i", "raw"))
    before = W.partitionBy("doc_id", "section_idx", "para_idx", "group_idx").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    cut = cut.withColumn("at", F.col("base") + F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0))).withColumn("text", strip("raw")).where("text <> ''")
    cut = cut.withColumn("start", (F.col("at") + _lead(F.col("raw"))).cast("int"))
    first = F.row_number().over(W.partitionBy("doc_id", "section_idx", "para_idx").orderBy("group_idx", "i")) == 1
    return cut.select("doc_id", "section_idx", "start", (F.col("start") + F.length("text")).cast("int").alias("end"), "text", first.alias("paragraph_start"), *path)


@dataclass(frozen=True)
class Length:
    """How long a text is: a function of the text and, where there is one, the same as a Spark expression.

    places: if given, the sorted places in a text of what is counted, none of which a cut goes through.
    """

    of: Callable[[str], int]
    column: Callable[[Column], Column] | None = None
    places: Callable[[str], list[int]] | None = None

    def measure(self, text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        if self.column is not None:
            return self.column(text)
        of = self.of
        return F.pandas_udf(lambda texts: texts.map(lambda t: int(of(t or ""))), T.IntegerType())(text)


_WORDS = re.compile(L.WORD)
WORDS = Length(lambda t: len(_WORDS.findall(t)), count_words, lambda t: [m.start() for m in _WORDS.finditer(t)])
CHARACTERS = Length(len, lambda c: F.length(F.coalesce(c, F.lit(""))))


def as_length(f: Length | Callable[[str], int] | None) -> Length:
    """Words if nothing is given; any function of a text, which need not add up over parts."""
    return WORDS if f is None else f if isinstance(f, Length) else Length(f)


#: Where long spans are cut, the preferred places first; after them between any two runs without white space.
CUTS = [re.compile(p) for p in (L.STRONG_MARKS, L.WEAK_MARKS, CONNECTIVE)]
_RUN = re.compile(f"{NOT_S}+")


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """The range without white space at its ends."""
    own = text[a:b]
    return b - len(own.lstrip()), a + len(own.rstrip())


def _packed(parts: list[tuple[int, int]], most: int, size: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Neighbouring parts put together as long as they fit; a part that is too long stands alone."""
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and size(out[-1][0], b) <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut_places(text: str, most: int, length: Length) -> list[tuple[int, int]]:
    """Ranges of a text that is longer than ``most``, each of at most that length unless it is one run without white space.

    A range is cut at the first kind of place that makes two or more of it, and what is still too long again.
    """
    if length.places is not None:
        counted = length.places(text)
        size = lambda a, b: bisect_left(counted, b) - bisect_left(counted, a)
    else:
        size = lambda a, b: length.of(text[a:b])
    todo, out = [(0, len(text))], []
    while todo:
        a, b = _bare(text, *todo.pop())
        if size(a, b) <= most:
            out.append((a, b))
            continue
        for cut in CUTS:
            edges = [a, *(a + m.end() for m in cut.finditer(text[a:b]) if a + m.end() < b), b]
            parts = _packed([x for x in zip(edges[:-1], edges[1:], strict=True) if text[x[0] : x[1]].strip()], most, size)
            if len(parts) > 1:
                todo += parts[::-1]
                break
        else:
            out += _packed([(a + m.start(), a + m.end()) for m in _RUN.finditer(text[a:b])], most, size)
    return out


def split_long(spans: DataFrame, max_tokens: int, length: Length = WORDS) -> DataFrame:
    """Spans (doc_id, start, end, text, paragraph_start, ...) cut until they are ``max_tokens`` long at most.

    First behind strong marks, what is still long behind weak ones, then before connectives, then between words; a
    run without white space is never cut.  Where a cut may be depends on lengths of all before it, so spans over
    the budget go through a vectorised function; all others never leave the JVM.
    """

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"a": a, "b": b} for a, b in cut_places(t, max_tokens, length)] for t in texts], dtype=object)

    keep = [c for c in spans.columns if c not in ("start", "end", "text", "paragraph_start")]
    found = spans.withColumn("cuts", places(F.when(length.measure("text") > max_tokens, F.col("text"))))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.length("text").alias("b")))
    # Texts are cut inside the array, so a long one is not copied for each of its pieces.
    parts = F.transform(F.coalesce("cuts", whole), lambda x, i: F.struct((F.col("start") + x["a"]).alias("start"), F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"]).alias("text"), (F.col("paragraph_start") & (i == 0)).alias("first")))
    out = found.select(*keep, F.explode(parts).alias("p"))
    return out.select(*keep, F.col("p.start").cast("int").alias("start"), (F.col("p.start") + F.length("p.text")).cast("int").alias("end"), F.col("p.text").alias("text"), F.col("p.first").alias("paragraph_start"))


def units(docs: DataFrame, max_tokens: int = 256, respect_structure: bool = True, length: Length = WORDS) -> DataFrame:
    """doc_id, unit_idx, section_idx, start, end, text, paragraph_start, tokens: what chunks are made of."""
    parts = split_long(sentences(sections(docs, respect_structure)), max_tokens, length)
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("section_idx", "start")) - 1
    return parts.select("doc_id", idx.alias("unit_idx"), "section_idx", "start", "end", "text", "paragraph_start", length.measure("text").alias("tokens"))
