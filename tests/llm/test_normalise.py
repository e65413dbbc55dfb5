"""One consistent form."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmark.llm import normalise as N

CASES = {
    "Fоrum": "Forum", "Ｎｅｗｓ": "News", "All categories": "All categories", "Archiv​e": "Archive", "Co­untry": "Country", "regiﬆration": "registration", "𝚜𝚊𝚏𝚎𝚝𝚢": "safety", "été": "été", "  a   b ": "a b",
    "a　b": "a b", "Even͏ts": "Events", "Тһе form": "The form", "ԁіе Seite": "die Seite", "Ａｌｌ　ｃａｔ": "All cat", "​": "", "o​̈": "ö",
}
SAME = [
    "", "plain", "Русская версия сайта", "Ελληνικά", "日本語", "한국어", "می‌خواهم بخوانم", "क्‍ष अक्षर", "👨‍👩‍👧 Press", "🏳️‍🌈 Home", "❤️ Forum", "24 m² and 3°", "and so…", "a – b — c", "“quoted” ‘so’ «oui»", "naïve café", "Tiếng Việt", "Íslenska", "½ cup", "Українська",
]


@pytest.mark.parametrize(("given", "want"), CASES.items())
def test_changed(given, want):
    assert N.consistent(given) == want


@pytest.mark.parametrize("value", SAME)
def test_kept(value):
    assert N.consistent(value) == value


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_form_of_a_form_is_itself(s):
    once = N.consistent(s)
    assert N.consistent(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_key_folds_case():
    assert N.key("Straße ＮＥＷＳ") == N.key("STRASSE news") == "strasse news"
    assert N.key(None) is None


def test_columns(spark):
    df = spark.createDataFrame([("Fоrum", "x", 1), (None, " ", 2), ("", "ok", 3), ("Ｎ" * 100_000, None, 4), ("Fоrum", "x", 1)], "text string, text_form string, n int")
    out = N.normalised(df, ["text"])
    assert out.columns == ["text", "text_form", "n", "text_form_2", "text_key"]
    got = {r["n"]: (r["text_form_2"], r["text_key"]) for r in out.collect()}
    assert got == {1: ("Forum", "forum"), 2: (None, None), 3: ("", ""), 4: ("N" * 100_000, "n" * 100_000)}


def test_inconsistent_once(spark):
    df = spark.createDataFrame([("p", "e", "Fоrum", "ok")] * 2 + [("p", "f", None, "a  b"), ("p", "g", "ok", None)], "page_id string, element_id string, text string, label string")
    got = {(r["element_id"], r["field"], r["form"]) for r in N.inconsistent(df, ["page_id", "element_id"], ["text", "label"]).collect()}
    assert got == {("e", "text", "Forum"), ("f", "label", "a b")}
    assert N.inconsistent(df.limit(0), ["page_id", "element_id"], ["text", "label"]).count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n", "\u2028", "\u0085"])
def test_line_ends_are_not_plain(spark, end):
    df = spark.createDataFrame([("k", "abc" + end)], "id string, v string")
    assert [r["form"] for r in N.inconsistent(df, ["id"], ["v"]).collect()] == ["abc"]


def test_runs_of_ignorables_of_any_length():
    """A joiner between emoji stays, however many invisible characters follow it."""
    for n in (0, 2, 9, 5000):
        assert N.consistent("👩\u200d" + "\u200b" * n + "💻") == "👩\u200d💻"


@pytest.mark.parametrize("s", ["abc", "  ａｂ\u00a0\u2003c\u0301 ", "е\u200bmail", "ﬁn\u0301", "", " ", "👩\u200d💻 x"])
def test_aligned(s):
    form, at = N.aligned(s)
    assert form == N.consistent(s)
    if at is not None:
        assert len(at) == len(form) + 1 and at == sorted(at) and at[-1] == len(s)
