"""Text functions, on sentences written for the rule they test."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from narrata.functions import text as t
from narrata.packs import fixed


def values(spark, data, expr):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, s string").orderBy("i").select(expr(F.col("s"))).collect()]


def test_sentences(spark):
    cases = {
        "We left. The tug stopped! [Note] it": ["We left.", "The tug stopped!", "[Note] it"],
        "We held at 5%.Tower called.": ["We held at 5%.", "Tower called."],
        "Cat vs. Dog and e.g. Birds. mr. Smith": ["Cat vs. Dog and e.g. Birds.", "mr. Smith"],
        "one\n\ntwo\n": ["one", "two"],
        "Ended at 3. 4 followed.": ["Ended at 3. 4 followed."],
        "": [],
        None: [],
    }
    assert values(spark, cases, t.sentences) == list(cases.values())


def test_words_and_tokens(spark):
    assert values(spark, ["The crew saw Smoke smoke, it was no fog", None], t.content_words) == [["saw", "smoke", "fog"], []]
    assert values(spark, [" a  b c ", "", None], t.word_count) == [3, 0, 0]
    assert values(spark, ["at 1,200 and é1 2 x3 4.5", None], t.number_tokens) == [["1,200", "2", "4.5"], []]
    assert values(spark, ["ATC saw TCAS RA, C-Check naïVE", None], t.acronyms) == [["TCAS", "RA", "C-"], []]
    assert values(spark, ["Gate B7 and Taxiway A, Gate B7, gate C1"], t.designators)[0] == [("Gate", "B7"), ("Taxiway", "A")]
    assert values(spark, ["\x1c a 　"], t.strip) == ["a"]


def test_truncate(spark):
    text = "First one here. " + "Filler words stand here. " * 20 + "Tail start. The very end."
    got, short = values(spark, [text, "short"], lambda c: t.truncate(c, 150))
    assert got["truncated"] and len(got["text"]) <= 150 and fixed.OMITTED in got["text"]
    assert got["text"].startswith("First one here.") and got["text"].endswith("The very end.") and not short["truncated"]
    long_word = values(spark, ["x" * 500], lambda c: t.truncate(c, 100))[0]
    assert len(long_word["text"]) == 100


def test_matches_in_context(spark):
    seen = values(spark, ["ab1cd22e", "none", "1"], lambda c: t.any_match(c, "[0-9]+", lambda before, after: (before == "ab1cd") & (after == "e")))
    assert seen == [True, False, False]
    assert values(spark, ["a1b22", "x", "7"], lambda c: t.replace_each(c, "[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">")))) == ["a<1>b<22>", "x", "<7>"]


def model_sentences(text):
    """An independent model: walks over the text, character by character."""
    text = re.sub(r"([a-z0-9%)])\.(?=[A-Z])", r"\1. ", text)
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] == "\n":
            out.append(text[start:i])
            start = i = i + 1
        elif text[i].isspace() and i and text[i - 1] in ".!?":
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            word = re.search(r"\S*\Z", text[:i])[0].lower()
            known = any(re.search(rf"(?:^|\W){re.escape(a.lower())}\Z", word) for a in fixed.ABBREVIATIONS)
            if not known and re.match(r"[A-Za-z\[\"']", text[j : j + 1]):
                out.append(text[start:i])
                start = j
                i = j
            else:
                i += 1
        else:
            i += 1
    return [s.strip() for s in [*out, text[start:]] if s.strip()]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["We", "saw", "vs.", "e.g.", "it.", "Mr.", "9.", "ok!", "[x]", "low.High", "why?", "\n", "U.S."]), max_size=12).map(" ".join), min_size=1, max_size=30))
def test_sentences_against_a_model(spark, data):
    assert values(spark, data, t.sentences) == [model_sentences(x) for x in data]
