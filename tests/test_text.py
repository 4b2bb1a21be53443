"""Text functions on forms that the driver's data lacks. All sentences are made up here."""

import pytest
from pyspark.sql import functions as F

from pramana.functions import text as T
from pramana.functions import translit as L


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "form,amounts",
    [
        ("toll of Rs.7,25,000/- on trucks", ["725000"]), ("INR 8400 and ₹ 9,100.50", ["8400", "9100"]), ("between 2.25 crore and 4 lac", ["22500000", "400000"]), ("कुल ६ लाख", ["600000"]), ("99 boats, 100 oars", ["100"]), ("no figure", []),
    ],
)
def test_amounts(spark, form, amounts):
    assert one(spark, form, T.canonical_amounts) == amounts


@pytest.mark.parametrize("text,n", [("Boats leave at six! Who waits?", 2), ("Ask Dr. Vane or Mrs. Oram. They row.", 2), ("नाव चली गई। नदी शांत है।", 2), ("   ", 0), (None, 0), ("no stop at all", 1)])
def test_sentences(spark, text, n):
    assert len(one(spark, text, T.split_sentences)) == n


def test_sentences_without_protection(spark):
    text = "Ask Dr. Vane."
    assert len(one(spark, text, T.split_sentences)) == 1 and len(one(spark, text, lambda c: T.split_sentences(c, protect_abbreviations=False))) == 2


@pytest.mark.parametrize(
    "text,kind,script",
    [("Does the ferry run on holidays?", "English", "latin"), ("Naav kahan milegi subah mein?", "Code-Mixed", "latin"), ("Ferry timing का समय", "Code-Mixed", "mixed"), ("नाव कहाँ रुकती है", "Indic", "deva"), (" ", "English", "unknown"), (None, "English", "unknown")],
)
def test_language(spark, text, kind, script):
    c = one(spark, text, T.classify_language)
    assert (c["query_type"], c["script"]) == (kind, script)


@pytest.mark.parametrize("text,script", [("नदी", "deva"), ("river", "latin"), ("river नदी tide ज्वार", "mixed"), ("...", "unknown"), ("7 नदी", "deva")])
def test_script(spark, text, script):
    assert one(spark, text, T.script_of) == script


def test_tokens(spark):
    assert one(spark, "The ferries of 3 z rowers", T.tokenize) == ["ferry", "3", "rower"]
    assert one(spark, "नदियों के", T.tokenize) == ["नदि"] or len(one(spark, "नदियों के", T.tokenize)) == 1
    assert one(spark, None, T.tokenize) == []


def test_answers_compare(spark):
    assert one(spark, "An Oar!", T.normalize_answer) == "oar"
    assert one(spark, "नाविकों केसाथ।", T.normalize_answer) == "नाविकों के साथ"
    assert one(spark, "Rs 6,200", T.amount_key) == "6200" and one(spark, "a toll of Rs 6,200 for each of the boats", T.amount_key) is None


def test_normalization_is_idempotent(spark):
    text = "\t‘oar’ – ८९…\n\n\n\n\nboat\u00a0house\nby the river"
    once = one(spark, text, T.normalize_text)
    assert one(spark, once, T.normalize_text) == once and "89" in once and "\n\n\n" not in once and "'oar'" in once


@pytest.mark.parametrize("text,roman", [("नाव नदी में है", "nav nadi men hai"), ("राम का घर", "ram ka ghar"), ("बीमा योजना", "bima yojana"), ("ज़मीन 25", "zamin 25"), ("plain", None), (None, None)])
def test_roman(spark, text, roman):
    assert one(spark, text, L.romanize_question) == roman
