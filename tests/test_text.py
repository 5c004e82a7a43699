import random

import pytest
from pyspark.sql import functions as F

from maqta.functions import text as T
from maqta.functions import words


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").coalesce(1)
    return [r[0] for r in rows.select(f(F.col("t"))).collect()]


def test_normalize(spark):
    cases = {"أُسْرَةٌ كُبرى": "اسره كبري", "سنة ١٩٩٨م": "سنه 1998 م", "نظامXML٢": "نظام xml2", "جـــدار": "جدار", "ﻛﺘﺎﺏ ﻼ": "كتاب لا", "ڤيلا گاز": "فيلا كاز", "": "", None: "", " x  y ": "x y", "ﷺ": "صلي الله عليه وسلم", "é①Ⅷ": "é1viii"}
    assert apply(spark, T.normalize_arabic, list(cases)) == list(cases.values())


def test_normalize_flags(spark):
    keep = lambda c: T.normalize_arabic(c, fold_letters=False, latin_digits=False, lowercase=False)
    assert apply(spark, keep, ["إC ٧"]) == ["إ C ٧"]


def test_light_stem(spark):
    cases = {"وبالجدار": "جدار", "السائقون": "سائق", "نهر": "نهر", "xml": "xml", "1998": "1998", "بيوتهما": "يوت"}
    assert apply(spark, T.light_stem, list(cases)) == list(cases.values())


def test_stems_drop_stopwords_and_tanween(spark):
    assert apply(spark, T.stems, ["نهراً على النهر", "of rivers", "عن مع"]) == [["نهر", "نهر"], ["rivers"], []]


def test_is_arabic(spark):
    assert apply(spark, T.is_arabic, ["سلام peace", "peace", "42", "", None, "سلام"]) == [True, False, False, False, False, True]


def test_count_words_splits_at_marks_and_accents(spark):
    assert apply(spark, T.count_words, ["مُدّة", "naïve x_2", None, "٥ ۶"]) == [3, 3, 0, 2]


@pytest.mark.parametrize(
    ("line", "level"),
    [("## فهرس", 2), ("##### ملحق #", 5), ("القسم الثالث - المياه", 1), ("الفصل السابع", 2), ("المبحث العاشر", 3), ("المطلب ٣: الري", 4), ("المادة (٧)", 4), ("مادة 19", 4), ("(8) مادة", 4), ("4.1.2 حدود النهر", 3), ("**السدود**:", 2), ("الخاتمة:", 2), ("References", 2), ("2. bar", 1)],
)
def test_headings(spark, line, level):
    assert apply(spark, lambda c: T.detect_heading(c)["level"], [line]) == [level]


def test_no_headings(spark):
    long = "الفصل السابع: " + "نهر " * 40
    assert apply(spark, T.detect_heading, ["يجري النهر نحو البحر.", "3. سطر مرقم له نهاية؟", "", None, long, "المادة تقول شيئا"]) == [None] * 6


def test_discourse(spark):
    found = apply(spark, T.discourse_bias, ["أخيراً يجري النهر", "لكن النهر جف", "النهر طويل", "• سد", "Finally, rivers", None])
    assert found == [1.0, -1.0, 0.0, -0.5, 1.0, 0.0]


def test_runs_agree_with_columns(spark):
    rng = random.Random(2)
    letters = "ابتثجحخدذرزسشصضطظعغفقكلمنهوية أإآٱىئؤةکیڤگ ًٌَُِّْـ abcXYZ09_ ٠١٢۳۴ .,،؛-•(\u200f\u00a0\u2003ﻼﷺéÉß①İ\n\t"
    parts = ["أما", "لذلك", "في المقابل", "however", "the", "كما", "- ", "(3) ", "وبال", "ونها"]
    texts = ["".join(rng.choice(parts) + " " if rng.random() < 0.1 else rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(400)] + ["", " \n", "من إلى"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    rows = rows.select("t", T.normalize_arabic("t").alias("n"), T.stems("t").alias("s"), T.discourse_bias("t", 0.25).alias("d")).collect()
    runs = words.Runs()
    for r in rows:
        assert " ".join(runs.normal_words(r["t"])) == r["n"] and runs.stems_of(r["t"]) == r["s"] and runs.discourse_bias(r["t"], 0.25) == r["d"]
