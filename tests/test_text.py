import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldtext.functions import text as T
from veldtext.plans.corpus import SALT

NORMAL = [
    ("HELLO WORLD", "hello world"), ("hello   world", "hello world"), ("hello, world!", "hello world"), ("  hello  ", "hello"),
    ("hello\t\nworld", "hello world"), ("  HELLO,  World!  ", "hello world"), ("ＨＥＬＬＯ", "hello"), ("", ""),
    ("İx", "ix"), ("ΣΣ", "σσ"), ("café × 2", "café 2"), ("éa", "éa"), ("a b", "a b"),
]
IMPERATIVE = [
    ("Run the command now", True), ("Execute this task", True), ("The file is here", False), ("I want to go", False), ("word", False),
    ("Delete everything", True), ("However the result", False), ("• x", True), ("“q x", True), ("émile x", True), ("אב x", False),
    ("1. x", False), ("- a", False), ("Installation: x", True), ("Installation of x", False), ("The, x", True), ("Bring it", True), ("City x", True),
]


def test_normal_form(spark):
    rows = spark.createDataFrame([(a, b) for a, b in NORMAL], "a string, b string").select(T.normalize(F.col("a")).alias("n"), "b")
    assert [(r.n, r.b) for r in rows.collect() if r.n != r.b] == []


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "a string").select(T.normalize(F.col("a")).alias("n")).first().n is None


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_normal_form_is_stable(text):
    once = T.normal_form(text)
    assert T.normal_form(once) == once


def test_salted_hash(spark):
    rows = spark.createDataFrame([("Test, pattern!",)], "a string").select(F.hex(T.salted(T.normalize(F.col("a")), SALT)).alias("h"))
    assert rows.first().h.lower() == hashlib.sha256(SALT + b"test pattern").hexdigest()


def test_grams(spark):
    rows = spark.createDataFrame([("one two three four five six",), ("one two",), ("",)], "a string").select(T.words(F.col("a")).alias("w"))
    out = rows.select(T.multi_ngrams(F.col("w")).alias("m"), T.ngrams(F.col("w"), 3).alias("t")).collect()
    assert [len(r.m) for r in out] == [6, 0, 0]
    assert out[0].t[0] == "one two three" and out[0].m[-1] == "one two three four five six"


def test_sentences(spark):
    rows = spark.createDataFrame([("First sentence. Second sentence! Third? Fourth.",), ("a\n\n b \n",), (" . ",)], "a string")
    out = [r.s for r in rows.select(T.sentences(F.col("a")).alias("s")).collect()]
    assert out == [["First sentence", "Second sentence", "Third", "Fourth."], ["a", "b"], []]


@pytest.mark.parametrize("chunk", [IMPERATIVE])
def test_imperative(spark, chunk):
    rows = spark.createDataFrame(chunk, "s string, want boolean").select("s", "want", T.imperative(F.col("s")).alias("got"))
    assert [(r.s, r.got) for r in rows.collect() if r.got != r.want] == []
