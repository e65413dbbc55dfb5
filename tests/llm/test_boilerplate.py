"""Main body: features by two implementations, held-out accuracy, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import boilerplate as B

E = "page_id string, element_id string, ord int, tag string, text string, href string, bbox struct<x:double,y:double,width:double,height:double>, extra string, title string"
P = "page_id string, title string, page_kind string, text string"


def page(pid="p"):
    body = "The reason is simple: a good chapter lasts for years, and that is usually enough for most readers."
    spec = [
        ("a", "Home", "/nav/1", 42.0), ("a", "Forum", "/nav/2", 46.0), ("a", "Sign in", "/nav/3", 41.0), ("h1", "A short history of the binding", None, 40.0), ("p", body, None, 40.0), ("p", body + " More of it.", None, 40.0), ("h2", "Background", None, 40.0),
        ("p", body, None, 40.0), ("h3", "Popular this week", None, 980.0), ("a", "Notes on the folio", "/asi/1", 980.0), ("p", "Trademarks belong to their owners and are named for description only.", None, 40.0), ("a", "Privacy", "/foo/1", 40.0),
        ("a", "Imprint", "/foo/2", 40.0), ("span", "© 2024 Site", None, 40.0), ("p", None, None, None), ("p", "", None, float("nan")),
    ]
    return [(pid, f"e{i}", i, t, x, h, None if b is None else (b, 0.0, 1.0, 1.0), "x", "clash") for i, (t, x, h, b) in enumerate(spec)]


def test_a_page(spark):
    e = spark.createDataFrame(page() * 2, E)
    p = spark.createDataFrame([("p", "A short history of the binding | Site", "article", "t")] * 2, P)
    got = [r["element_id"] for r in B.main_body(spark, e, p).orderBy("ord").collect()]
    assert got == ["e3", "e4", "e5", "e6", "e7"]


def test_pages_not_given_have_no_rows(spark):
    assert B.main_body(spark, spark.createDataFrame(page("q"), E), spark.createDataFrame([("p", "x", "article", "t")], P)).count() == 0


def test_empty_tables(spark):
    assert B.main_body(spark, spark.createDataFrame([], E), spark.createDataFrame([], P)).count() == 0


def test_long_and_odd_texts(spark):
    rows = [("p", "a", 1, None, "word " * 200_000, None, None, None, None), ("p", "b", 1, "p", "​  ", None, None, None, None), (None, "c", None, "p", "x", None, None, None, None)]
    p = spark.createDataFrame([("p", None, "article", None), (None, "t", "article", None)], P)
    assert B.scored(spark, spark.createDataFrame(rows, E), p).count() == 2


def test_features_agree_with_the_windows(spark):
    """The features the tree was fitted on are those the windows compute."""
    rows = B.labelled()
    rows = rows[rows.page_id.isin(rows.page_id.unique()[:6])].copy()
    scores, _ = B.model()
    want = B.local_features(rows, scores)
    rows["open_score"] = rows.opening.map(scores).fillna(0.0)
    rows = rows.assign(element_id=[f"{i:06d}" for i in range(len(rows))], text="x", known_x=rows.known_x.astype(object).where(rows.known_x.notna(), None), ord=range(len(rows)))
    for c in ("n_words", "is_link", "tag_class", "ends", "is_title"):
        rows[c] = rows[c].astype(float)
    schema = "page_id long, element_id string, ord int, text string, n_words double, is_link double, tag_class double, ends double, known_x double, opening string, is_title double, open_score double"
    b = spark.createDataFrame([tuple(r) for r in rows[[c.split()[0] for c in schema.split(", ")]].itertuples(index=False)], schema)
    got = B.featured(b).orderBy("element_id").toPandas()[list(B.FEATURES)].to_numpy(float)
    assert np.allclose(got, want)


def test_held_out_accuracy():
    rows = B.labelled()
    pages = rows.page_id.unique()
    train, test = rows[rows.page_id.isin(pages[::2])], rows[rows.page_id.isin(pages[1::2])]
    scores = B.opening_scores(train)
    tree = B.grow(B.local_features(train, scores), train.y.to_numpy(float), 9, 4)
    x, y = B.local_features(test, scores), test.y.to_numpy() == 1

    def ask(t, v):
        while "p" not in t:
            t = t["le"] if v[t["f"]] <= t["at"] else t["gt"]
        return t["p"] >= 0.5

    found = np.array([ask(tree, v) for v in x])
    assert (found & y).sum() / found.sum() > 0.95 and (found & y).sum() / y.sum() > 0.9


def test_tree_on_ties():
    assert B.grow(np.zeros((10, 2)), np.array([0.0, 1.0] * 5), 3, 1) == {"p": 0.5}


@pytest.mark.parametrize("text", ["", None])
def test_folded(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(B.folded(F.col("t")).alias("r")).first()["r"] == text
