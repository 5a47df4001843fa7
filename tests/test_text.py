import re

import pytest
from pyspark.sql import functions as F

from triagework import domain
from triagework.functions import text

SAMPLES = [
    "don't <b>x</b> https://a.b/c www.z.com 5-2!",
    "    HELLO\u0085 World  ",
    "",
    "   \t\n",
    "a<unclosed tag b> c<>d",
    "http:/nolink https://x y https://é.fr/ü z",
    "Ärger über Größe 100% naïve x2 b_c ²",
    "line one\r\nline\x1ctwo\x1f three",
    "issue issues ISSUE, not working! notworking problem? can't cannot",
    "URGENT: urgently down; downtime éurgent urgenté fraud-security",
    "<<a>>b www.x<y>z www.",
]


#: What the light and the strict cleaner make of each sample.
LIGHT = [
    "don't x   5-2!",
    "hello\x85 world",
    "",
    "",
    "a c<>d",
    "http:/nolink  y\u2003 z",
    "ärger über größe 100% naïve x2 b_c ²",
    "line one\r\nline\x1ctwo\x1f three",
    "issue issues issue, not working! notworking problem? can't cannot",
    "urgent: urgently down; downtime éurgent urgenté fraud-security",
    ">b  www.",
]
STRICT = [
    "don't x",
    "hello\x85 world",
    "",
    "",
    "a cd",
    "httpnolink  y\u2003 z",
    "rger ber gre  nave x bc",
    "line one\r\nline\x1ctwo\x1f three",
    "issue issues issue not working notworking problem can't cannot",
    "urgent urgently down downtime urgent urgent fraudsecurity",
    "b  www",
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "n int, t string")


def values(df, column):
    return [row[0] for row in df.orderBy("n").select(column).collect()]


def test_cleaners(samples):
    assert values(samples, text.clean_light(F.col("t"))) == LIGHT
    assert values(samples, text.clean_strict(F.col("t"))) == STRICT


def test_word_count_follows_python(samples):
    assert values(samples, text.word_count(F.col("t"))) == [len(s.split()) for s in SAMPLES]


def test_blank_texts(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "  \t"), (3, " a ")], "n int, t string")
    assert values(df, text.is_blank(F.col("t"))) == [True, True, True, False]
    assert values(df, text.word_count(F.col("t"))) == [0, 0, 0, 1]


def test_only_whole_words_count(samples):
    problem = re.compile(r"\b(" + "|".join(domain.PROBLEM_WORDS) + r")\b")
    lowered = [s.lower() for s in SAMPLES]
    found = values(samples, text.count_whole_words(F.lower("t"), domain.PROBLEM_WORDS))
    assert found == [len(problem.findall(s)) for s in lowered]
    urgency = re.compile(r"\b(" + "|".join(domain.URGENCY_WORDS) + r")\b")
    found = values(samples, text.light_statistics(F.col("t"), F.col("t"))["Urgency_Word_Count"])
    assert found == [len(urgency.findall(s)) for s in lowered]


def test_punctuation_counts(samples):
    statistics = text.text_statistics(F.col("t"), F.col("t"))
    assert values(samples, statistics["Exclamation_Count"]) == [s.count("!") for s in SAMPLES]
    assert values(samples, statistics["Question_Count"]) == [s.count("?") for s in SAMPLES]
    assert values(samples, statistics["Subject_Length"]) == [len(s) for s in SAMPLES]


def test_tokens_and_pairs(samples):
    words = [re.findall(r"(?u)\b\w\w+\b", s.lower()) for s in SAMPLES]
    assert values(samples, text.tokens(F.col("t"))) == words
    grams = values(samples.withColumn("w", text.tokens(F.col("t"))), text.one_and_two_grams(F.col("w")))
    assert grams == [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]


def test_stop_words_leave_before_pairing(spark):
    df = spark.createDataFrame([("not the issue",)], "t string").withColumn("w", text.tokens(F.col("t"), ["the"]))
    assert df.select(text.one_and_two_grams(F.col("w"))).first()[0] == ["not", "issue", "not issue"]


def test_combined_texts_keep_nulls_apart(spark):
    df = spark.createDataFrame([(None, None, "d")], "c string, s string, d string")
    row = df.select(
        text.model_text(F.col("c"), F.col("s"), F.col("d")), text.resolution_text(F.col("s"), F.col("d"))
    ).first()
    assert tuple(row) == ("category  subject  description d", " d")
