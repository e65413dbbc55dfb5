"""The functions by their SQL names against the expressions they stand for."""

from pyspark.sql import functions as F

from veilmark.functions import geometry as G
from veilmark.functions import sql
from veilmark.functions import text as X

TEXTS = ["write to a@b.example or 415-555-0199", "4111 1111 1111 1111", "4111111111111112", "0000 0000 0000 0000", "", None, "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "ABCDE1234F, 123-45-6789"]


def test_same_as_expressions(spark):
    sql.register(spark)
    sql.register(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    for r in spark.sql("SELECT *, scrub_text(s) AS scrubbed, luhn_valid(s) AS valid FROM {d}", d=df.select("s", X.scrub(F.col("s")).alias("want"), X.luhn(F.col("s")).alias("is"))).collect():
        assert r["scrubbed"] == r["want"] and r["valid"] == r["is"], r
    box = "struct<x:double,y:double,width:double,height:double>"
    pairs = [((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 2.0, 2.0)), ((0.0, 0.0, 0.0, 2.0), (0.0, 0.0, 1.0, 1.0)), ((0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 1.0, 1.0))]
    b = spark.createDataFrame(pairs, f"a {box}, b {box}")
    assert all(r["x"] == r["y"] for r in spark.sql("SELECT bbox_iou(a, b) AS x, y FROM {d}", d=b.withColumn("y", G.iou(F.col("a"), F.col("b")))).collect())


def test_html_elements(spark):
    sql.register(spark)
    got = spark.sql("SELECT ord, tag, text, href FROM html_elements('<ul><li>one<li><a href=\"/x\">two</a></ul><svg>no</svg>')").collect()
    assert [tuple(r) for r in got] == [(1, "ul", None, None), (2, "li", "one", None), (3, "li", None, None), (4, "a", "two", "/x")]
    assert spark.sql("SELECT * FROM html_elements(NULL)").count() == spark.sql("SELECT * FROM html_elements('')").count() == 0
