"""The functions under SQL names: scrub_text, luhn_valid, bbox_iou as SQL functions, html_elements as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions.text import SCRUB

BOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
TABLE = "ord int, parent_ord int, tag string, role string, text string, label string, input_type string, placeholder string, href string, src string, alt string, html_id string, xpath string"


def _scrub() -> str:
    out = "s"
    for p in SCRUB:
        out = f"regexp_replace({out}, R'{P.java(p)}', R'\\{P.REDACTED}')"
    return out


def _luhn() -> str:
    digits = "split(reverse(regexp_replace(s, '[^0-9]', '')), '')"
    weighted = f"transform({digits}, (x, i) -> CASE WHEN i % 2 = 0 THEN int(x) ELSE (int(x) * 2) % 10 + int(x) DIV 5 END)"
    number = "regexp_replace(s, '[^0-9]', '')"
    return f"coalesce(length({number}) BETWEEN 13 AND 19 AND NOT {number} RLIKE R'^(\\d)\\1+$' AND aggregate({weighted}, 0L, (a, x) -> a + x) % 10 = 0, false)"


def _iou() -> str:
    inter = "greatest(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x), 0D) * greatest(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y), 0D)"
    union = f"(a.width * a.height + b.width * b.height - {inter})"
    return f"CASE WHEN a.width * a.height > 0 AND b.width * b.height > 0 AND {union} > 0 THEN {inter} / {union} ELSE 0D END"


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; a second time changes nothing.

    The SQL functions are inlined by the optimiser, so they cost what the expressions cost. html_elements yields the
    element rows of one HTML text in document order; null and empty texts have none.
    """
    for name, takes, gives, body in (("scrub_text", "s STRING", "STRING", _scrub()), ("luhn_valid", "s STRING", "BOOLEAN", _luhn()), ("bbox_iou", f"a {BOX}, b {BOX}", "DOUBLE", _iou())):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")

    @F.udtf(returnType=TABLE)
    class Elements:
        def eval(self, html: str) -> Iterator[tuple]:
            from veilmark.sources.html import tokenize

            for r in tokenize(html):
                yield tuple(r[c.split()[0]] for c in TABLE.split(", "))

    spark.udtf.register("html_elements", Elements)
