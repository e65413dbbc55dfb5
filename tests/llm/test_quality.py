"""Text statistics against a plain loop; kinds on hand-made documents."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmark.llm import quality as Q

PROSE = "The reader asked whether the folio can be closed before noon, and that is usually enough. It took six days to check the hinges in the usual order. "
DOCS = {
    PROSE * 3: "prose",
    PROSE.upper() * 2: "prose",
    "ask for the folio before noon, it is the one on the desk and it was not closed": "prose",
    PROSE + "\n\n- one folio\n- two folios\n- the reader\n\n" + PROSE: "prose",
    "Die Küche und das Gerät bleiben wichtig, und das genügt in der Regel. Es ist nicht so, wie es war.": "prose",
    "- one folio\n- two folios\n* the reader, closed before noon\n- a desk\n• three bindings": "list",
    "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |": "table",
    "id,name,qty\n1,folio,3\n2,desk,4\n3,reader,9": "table",
    "1\t2\t3\n4\t5\t6\n7\t8\t9\n1\t1\t1": "table",
    "Folio .......... 12\nDesk ....... 14\nReader ........ 90": "table",
    "2025-03-04 23:14:07 DEBUG gate scan_ms=4.43\n2025-03-04 23:14:08 WARN gate scan_ms=1.2\n2025-03-04 23:15:07 INFO gate scan_ms=9.43": "dump",
    '[{"id": "e-0", "bbox": [13, 356]}, {"id": "e-1", "bbox": [1, 6]}]': "dump",
    "Loading... " * 40: "junk",
    "folio reader folio desk reader " * 30: "junk",
    "replaced loose first useful different effort third collected furrow small memory little renamed": "junk",
    "Czytelnik zapytał, czy można zamknąć tę księgę przed południem. Nikt nie wiedział, dlaczego biuro było już puste, więc wszyscy poszli do domu.": "prose",
    "Читатель спросил, можно ли закрыть эту книгу до полудня. Никто не знал, почему стол был уже пуст, и все пошли домой.": "prose",
    "Il lettore ha chiesto se il libro si può chiudere prima di mezzogiorno. Nessuno sapeva perché la scrivania era già vuota, e tutti sono andati a casa.": "prose",
    "\n".join(["9j4AAQSkZJRgABAQEASABIAAD2wBDAAMCAgMCAgMDAwMEAwMEBQgFBQQEBQoHBwYI"] * 6 + ["DAoMDAsKCwsNDhIQDQ4RDgsLEBYQERMU"]): "dump",
    "\n".join(f"{' ' * 2 * (i % 2 + 1)}branch node with a few more words of text {'x' * (i % 5)}" for i in range(24)): "dump",
}


@pytest.mark.parametrize("i", range(len(DOCS)))
def test_kinds(spark, i):
    text, want = list(DOCS.items())[i]
    got = Q.classified(spark.createDataFrame([(text,)], "text string")).first()["kind"]
    assert got == want


def loop(t):
    """The statistics one character and line at a time, where they are simple to say."""
    words = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", t)
    letters = sum(c.isalpha() for c in t)
    lines = [x for x in t.split("\n") if x.strip()]
    return {
        "n_words": len(words), "mean_word_length": letters / len(words) if words else 0, "letter_ratio": letters / len(t) if t else 0, "n_lines": len(lines), "longest_token": max((len(x) for x in t.split()), default=0),
        "end_punct_ratio": sum(bool(re.search(r"[.!?:;…。][\"'”’»)\]]{0,2}\s*$", x)) for x in lines) / len(lines) if lines else 0,
    }


ALPHABET = "abcdeÉß \n\t.,;!?-'\"()|*#0123"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=6))
def test_against_a_loop(texts):
    got = Q.describe(texts)
    for i, t in enumerate(texts):
        for k, v in loop(t).items():
            assert abs(float(got[k][i]) - v) < 1e-9, (k, t)


def test_texts_do_not_touch():
    """A document's statistics are the same alone and among others."""
    r = random.Random(4)
    texts = [*DOCS, "", " ", "x", "\n\n", *("".join(r.choice(ALPHABET) for _ in range(r.randrange(400))) for _ in range(40))]
    whole = Q.describe(texts)
    for i, t in enumerate(texts):
        alone = Q.describe([t])
        for k in Q.STATISTICS:
            assert np.isclose(float(alone[k][0]), float(whole[k][i])), (k, t)


def test_periods():
    d = Q.describe(["aa\nbbbb\n" * 6, "same\n" * 8, "a\nbbbbbb\nccc\ndd\neeeeeee\nf\nggg\nhhhhh"])
    assert d["length_period"][0] > 0.8 and d["length_period"][1] == 1.0 and d["length_period"][2] < 0.6


def test_nulls_extra_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, PROSE * 4000, "z"), (3, PROSE * 4000, "z")], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in Q.classified(df).collect()}
    assert got[1]["kind"] is None and got[1]["n_words"] is None
    assert got[2]["n_words"] == 0 and got[2]["n_lines"] == 0
    assert got[3]["kind"] == "prose" and got[3]["n_words"] == 112_000
    assert Q.classified(df.limit(0)).count() == 0


def test_common_words_are_learned(spark):
    rows = [(i, f"the folio of desk {i} is the one of the reader", "en") for i in range(40)] + [(i, f"der Band {i} und der Leser und", "de") for i in range(40)] + [(99, "once upon", "xx"), (98, None, "en"), (97, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = Q.common_words(df, most=3, least_share=0.05)
    # ties are broken by the alphabet; a language of one document in 80 is none
    assert words == ["band", "der", "desk", "folio", "is", "leser"]
    got = {r["doc_id"]: r["common_ratio"] for r in Q.statistics(df, common=["der", "und"]).filter("lang = 'de'").collect()}
    assert all(0.4 < v < 0.9 for v in got.values())
    assert Q.common_words(df.limit(0)) == []


def test_each_layout_measure_decides():
    """Documents that only the layout shows: letters, symbols and words are those of prose."""
    lines = {k: v for v, k in (("bullet_ratio", "\n".join(f"- the reader of the folio can be asked whether desk is closed {'x' * i}" for i in range(8))), ("field_alignment", "\n".join(f"reader: folio of the desk and the binding: closed before noon {'y' * i}" for i in range(8))))}
    for text, measure in lines.items():
        d = Q.describe([text])
        assert d[measure][0] >= 0.6 and d["letter_ratio"][0] > 0.6 and d["symbol_ratio"][0] < 0.05 and d["n_words"][0] > 3.5 * d["n_lines"][0]
