import random
import re

from maqta.operators import sentences as B
from maqta.operators import structure as A
from maqta.functions.text import detect_heading

POLICY = """# السياسة

نص قبل الأقسام.

## مقدمة

جملة أولى هنا. جملة ثانية هناك.

## العقوبات

المادة (1)
يُعاقب كل موظف.

المادة (2)
في حال التكرار يُحال الموظف إلى اللجنة.
"""


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(spark, text):
    rows = B.sentences(A.sections(frame(spark, [text]), False)).orderBy("start").collect()
    for r in rows:
        assert text[r["start"] : r["end"]] == r["text"]
    return [(r["text"], r["paragraph_start"]) for r in rows]


def test_sections_and_paths(spark):
    rows = A.sections(frame(spark, [POLICY])).orderBy("section_idx").collect()
    assert [r["headings"] for r in rows] == [["السياسة"], ["السياسة", "مقدمة"], ["السياسة", "العقوبات", "المادة (1)"], ["السياسة", "العقوبات", "المادة (2)"]]
    for r in rows:
        assert POLICY[r["start"] : r["end"]] == r["body"]
        assert r["heading_start"] < r["start"]


def test_path_equals_a_stack(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(30):
        texts.append("".join(f"{'#' * rng.randint(1, 6)} h{i}\nb{i}\n" for i in range(rng.randint(1, 12))))
    got = {}
    for r in A.sections(frame(spark, texts)).orderBy("doc_id", "section_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["headings"])
    for k, text in enumerate(texts):
        stack, want = [], []
        for level, name in re.findall(r"(#+) (h\d+)", text):
            stack = [s for s in stack if s[0] < len(level)] + [(len(level), name)]
            want.append([n for _, n in stack])
        assert got[k] == want


def test_lines_end_at_every_line_break(spark):
    text = "a\r\nb\rc\x0bd\x85e f\n\n"
    rows = A.lines(frame(spark, [text])).orderBy("line_idx").collect()
    assert [r["line"] for r in rows] == text.splitlines(keepends=True)


def test_empty_documents_have_no_section(spark):
    assert A.sections(frame(spark, ["", None, " \n ", "# only a heading"])).count() == 0


def test_plain_sentences(spark):
    assert [s for s, _ in spans(spark, "ذهب الولد. هل عاد؟ نعم!")] == ["ذهب الولد.", "هل عاد؟", "نعم!"]


def test_abbreviations_decimals_eras(spark):
    found = spans(spark, "قال د. أحمد إن النسبة 3.5 في المئة عام 1445 هـ. ثم غادر.")
    assert [s[-3:] for s, _ in found] == ["هـ.", "در."]
    assert len(spans(spark, "He lives in the U.S.A. now. See no. 5 there. Dr. A. Ali left.")) == 3
    assert len(spans(spark, "apples etc. and more. Plums etc. More came.")) == 3


def test_a_dot_inside_a_word_leaves_later_dots_alone(spark):
    early, late = "write to a.b04@mail8.example.com ", "entre que oueau ou elle des " * 5
    assert [s for s, _ in spans(spark, f"{early}{late}é. Un mot.")] == [f"{early}{late}é. Un mot."]
    assert [s for s, _ in spans(spark, f"a%b.c {late}fin. Un mot.")] == [f"a%b.c {late}fin.", "Un mot."]
    assert [s for s, _ in spans(spark, f"😀 {early}😀 {late}é. Un mot.")] == [f"😀 {early}😀 {late}é. Un mot."]


def test_wrapped_lines_and_lists(spark):
    found = [s for s, _ in spans(spark, "سطر ملفوف\nيكمل هنا.\n- بند أول\n- بند ثان")]
    assert found == ["سطر ملفوف\nيكمل هنا.", "- بند أول", "- بند ثان"]


def test_paragraph_flags(spark):
    assert [p for _, p in spans(spark, "واحد. اثنان.\n  \nثلاثة.")] == [True, False, True]


def test_offsets_count_code_points(spark):
    assert [s for s, _ in spans(spark, "😀😀 one. 😀 two.")] == ["😀😀 one.", "😀 two."]


def test_split_long(spark):
    text = "كلمة " * 7 + "ثم ؛ " + "جزء، " * 12 + "وبالتالي " + "طويل " * 25 + "آخر"
    rows = B.units(frame(spark, [text]), 10, False).orderBy("unit_idx").collect()
    assert all(r["tokens"] <= 10 for r in rows) and rows[0]["text"].endswith("؛")
    assert [r["paragraph_start"] for r in rows] == [True] + [False] * (len(rows) - 1)
    assert "".join(r["text"] for r in rows).replace(" ", "") == text.replace(" ", "")
    for r in rows:
        assert text[r["start"] : r["end"]] == r["text"]


def test_one_run_is_never_cut(spark):
    rows = B.units(frame(spark, ["a-b-c-d-e-f-g-h"]), 3, False).collect()
    assert [(r["tokens"], r["text"]) for r in rows] == [(8, "a-b-c-d-e-f-g-h")]


def test_units_need_two_exchanges(spark):
    df = frame(spark, [POLICY]).repartition(4)
    plan = B.units(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan.split("== Initial Plan ==")[-1])) == 2


def test_detect_heading_in_select(spark):
    assert frame(spark, ["# x"]).select(detect_heading("text")["heading"].alias("h")).first()["h"] == "x"
