"""Text functions against the rules in plain Python and golden cases."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import unicode as U

TEXTS = ["A-b «É» 1_x", "Straße", "!!", "", "û«x»  y", "Maan bala, koosda bala.", "ẽ Ãb", "Å ς µ", "a\x1cb c", "Ⅷ ² ٣ x", "ʋɩ Ɛ"]


def on(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_key_is_the_rule_when_exact(spark):
    want = [re.sub(r"[^\w]", "", unicodedata.normalize("NFC", t).casefold()) for t in TEXTS]
    assert on(spark, TEXTS, T.key(F.col("t"), exact=True)) == want
    assert on(spark, ["A-b «É» 1_x", "Straße", "!!"], T.key(F.col("t"))) == ["abé1_x", "strasse", ""]


def test_clean(spark):
    assert on(spark, ["û«x»  y", " a – b ’‘ ", "ẽ"], T.clean(F.col("t"), exact=True)) == ['ũ"x" y', "a - b ’’", "ẽ"]


def test_words_keep_unnormalised_text(spark):
    want = [re.findall(r"[^\W\d_]+", t.casefold()) for t in TEXTS]
    assert on(spark, TEXTS, T.words(F.col("t"), exact=True)) == want


def test_normal_forms_pass_nulls(spark):
    assert on(spark, [None, "é"], U.nfc(F.col("t"))) == [None, "é"]
    assert on(spark, [None, "é"], U.nfd(F.col("t"))) == [None, "é"]


@pytest.mark.parametrize("text,want", [("Yel-bũnd bʋg n yet woto?", True), ("xyzzy plugh", True), ("", False), ("Je ne sais pas.", False), ("Le proverbe dit que les autres", False), ("A yi.", True), ("seul", False)])
def test_written_in(spark, text, want):
    assert on(spark, [text], T.written_in_moore(F.col("t"))) == [want]


def test_written_in_with_lexicon(spark):
    lexicon = ["maan", "bala", "koosda", "a", "yi"]
    assert on(spark, ["Maan bala, koosda bala.", "xyzzy plugh", "A yi."], T.written_in_moore(F.col("t"), lexicon)) == [True, False, True]


def test_letters(spark):
    assert on(spark, ["Aɔ cŋ b"], F.array_join(T.outside_alphabet(F.col("t")), "")) == ["cŋɔ"]
    assert on(spark, ["Aɔ cŋ b"], F.array_join(T.foreign_letters(F.col("t")), "")) == ["ŋɔ"]


def test_first_line(spark):
    assert on(spark, ["\n« Ne y taabo »\nCela veut dire bonne année.", "   ", "a\r\nb"], T.first_line(F.col("t"))) == ["Ne y taabo", "", "a"]


def test_overlap_is_of_distinct_words(spark):
    df = spark.createDataFrame([("a b a", "B c"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(T.overlap(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


def test_prompts_and_names(spark):
    df = spark.createDataFrame([("x", "french_to_moore"), ("x", "moore_to_french"), ("x", "other")], "t string, d string")
    assert [r[0] for r in df.select(T.translation_prompt(F.col("t"), F.col("d"))).collect()] == ["Traduis cette phrase en mooré.\n\nx", "Traduis cette phrase en français.\n\nx", None]
    assert on(spark, ["a+b/c"], T.file_name(F.col("t"))) == ["a_b_c"]
    assert on(spark, ["1.5"], T.decimal_comma(F.col("t"))) == ["1,5"]
    assert on(spark, ["fr\n\nmos", "solo"], T.source_side(F.col("t"))) == ["fr", "solo"]
