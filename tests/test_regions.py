"""Boxes: canonical form, merging, suppression, matching; the prior grid; pixels."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark.functions import geometry as G
from veilmark.operators import regions, vision

BOX = "struct<x:double,y:double,width:double,height:double>"


def region(i, x, y, w, h, **kw):
    return {"region_id": f"r{i}", "type": "email", "x": float(x), "y": float(y), "width": float(w), "height": float(h), "confidence": 0.9, "severity": "medium", "redaction": "mask", "merged_from": [f"r{i}"], **kw}


def test_overlap_measures(spark):
    r = spark.createDataFrame([((0.0, 0.0, 100.0, 100.0), (50.0, 0.0, 100.0, 100.0))], f"a {BOX}, b {BOX}").select(G.iou(F.col("a"), F.col("b")).alias("i"), G.containment(F.col("a"), F.col("b")).alias("c"), G.intersection(F.col("a"), F.col("b")).alias("n")).first()
    assert (round(r["i"], 3), r["c"], r["n"]) == (0.333, 0.5, 5000.0)


def test_zero_area(spark):
    r = spark.createDataFrame([((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 10.0, 10.0))], f"a {BOX}, b {BOX}").select(G.iou(F.col("a"), F.col("b")).alias("i"), G.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert (r["i"], r["c"]) == (0.0, 0.0)


def test_canonical_numbers(spark):
    df = spark.createDataFrame([((float("nan"), -50.0, float("inf"), -10.0), float("nan"), "password", None, None)], f"bbox {BOX}, confidence double, type string, severity string, redaction string")
    r = regions.canonical(df).first()
    assert tuple(r["bbox"]) == (0.0, 0.0, 100000.0, 1.0)
    assert (r["confidence"], r["severity"], r["redaction"]) == (0.5, "critical", "blackout")


def test_merge_two_kinds_of_box():
    out = regions.merge_page([region(1, 100, 150, 200, 30), region(2, 110, 148, 195, 35)])
    assert len(out) == 1
    assert (out[0]["x"], out[0]["y"], out[0]["width"], out[0]["height"]) == (100, 148, 205, 35)
    assert sorted(out[0]["merged_from"]) == ["r1", "r2"]


def test_merge_keeps_the_stronger():
    out = regions.merge_page([region(1, 0, 0, 100, 100, type="face", redaction="blur"), region(2, 10, 10, 50, 50, type="credit_card", severity="critical", redaction="blackout", confidence=1.0)])
    assert len(out) == 1 and out[0]["type"] == "credit_card" and out[0]["severity"] == "critical" and out[0]["redaction"] == "blackout" and out[0]["confidence"] == 1.0


def test_disjoint_boxes_stay():
    assert len(regions.merge_page([region(1, 0, 0, 10, 10), region(2, 100, 100, 10, 10)])) == 2


def test_merge_is_independent_of_order():
    rs = [region(1, 0, 0, 50, 50), region(2, 20, 20, 50, 50), region(3, 300, 0, 20, 20), region(4, 45, 45, 60, 60)]
    want = None
    for p in itertools.permutations(rs):
        got = sorted((r["x"], r["y"], r["width"], r["height"]) for r in regions.merge_page([dict(r) for r in p]))
        want = want or got
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 100), st.integers(1, 60), st.integers(1, 60)), min_size=1, max_size=12))
def test_merge_loses_no_region(boxes):
    out = regions.merge_page([region(i, *b) for i, b in enumerate(boxes)])
    assert sorted(x for r in out for x in r["merged_from"]) == sorted(f"r{i}" for i in range(len(boxes)))


def test_nms_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("p" + str(i % 4), f"b{i:03d}", i, float(rng.random()), tuple(float(v) for v in (*rng.integers(0, 60, 2), *rng.integers(10, 50, 2)))) for i in range(120)]
    got = {(r["page_id"], r["box_id"]) for r in regions.nms(spark.createDataFrame(rows, f"page_id string, box_id string, ord int, score double, bbox {BOX}"), ["page_id"], 0.3).collect()}
    want = set()
    for page in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[3], r[2])):
            if all(regions._overlap(list(r[4]), list(k[4]))[0] <= 0.3 for k in kept):
                kept.append(r)
        want |= {(page, k[1]) for k in kept}
    assert got == want


def test_best_detection_wins(spark):
    e = spark.createDataFrame([("p", "btn", (10.0, 10.0, 100.0, 50.0)), ("p", "far", (500.0, 500.0, 10.0, 10.0))], f"page_id string, element_id string, bbox {BOX}")
    v = spark.createDataFrame([("p", "v1", 0, (300.0, 300.0, 50.0, 50.0), 0.8), ("p", "v2", 1, (12.0, 12.0, 95.0, 45.0), 0.9), ("p", "v3", 2, (60.0, 10.0, 100.0, 50.0), 0.99)], f"page_id string, detection_id string, ord int, bbox {BOX}, confidence double")
    got = {(r["element_id"], r["detection_id"], r["source"]) for r in regions.match_detections(e, v, ["page_id"]).collect()}
    assert got == {("btn", "v2", "merged"), ("far", None, "dom"), (None, "v1", "vision"), (None, "v3", "vision")}


def test_priors(spark):
    p = vision.priors(spark)
    assert p.count() == 4420
    first = p.filter("ord = 0").first()
    assert first["cx"] < 0.5 and first["cy"] < 0.5


@pytest.fixture
def image():
    a = np.full((200, 300, 3), 255, np.uint8)
    a[10:30, 10:60] = (255, 0, 0)
    a[10:30, 100:150] = (0, 255, 0)
    a[10:30, 200:250] = (0, 0, 255)
    return a


def test_pixels_painted_over(image):
    out = vision.redact_pixels(image, [{"x": 10, "y": 10, "width": 50, "height": 20, "redaction": "blackout"}, {"x": 100, "y": 10, "width": 50, "height": 20, "redaction": "mask"}])
    assert tuple(out[20, 25]) == (0, 0, 0) and tuple(out[20, 125]) == (108, 117, 125) and tuple(out[20, 225]) == (0, 0, 255)
    assert tuple(image[20, 25]) == (255, 0, 0)


def test_blur_and_outside(image):
    out = vision.redact_pixels(image, [{"x": 0, "y": 0, "width": 80, "height": 60, "redaction": "blur"}, {"x": 900, "y": 900, "width": 5, "height": 5, "redaction": "mask"}])
    assert out.shape == image.shape and tuple(out[20, 35]) != (255, 0, 0)


def test_text_bands():
    a = np.full((100, 200, 3), 255, np.uint8)
    a[40:56, ::4] = 0
    assert [(b["y"], b["height"]) for b in vision.text_lines(a)] == [(40, 16)]


def test_large_pages_are_merged_whole(spark):
    n = 1501
    rows = [("p", f"r{i:04}", "email", (20.0 * i, 0.0, 10.0, 10.0), 0.9, "medium", "mask") for i in range(n)] + [("p", "twin", "email", (1.0, 0.0, 10.0, 10.0), 0.8, "medium", "mask")]
    df = spark.createDataFrame(rows, "page string, region_id string, type string, bbox struct<x:double,y:double,width:double,height:double>, confidence double, severity string, redaction string")
    out = regions.merge_regions(df, "page").collect()
    assert len(out) == n and sum(len(r["merged_from"]) for r in out) == n + 1


def test_a_page_sized_box_stays_few_rows(spark):
    """Boxes from a pixel to the limit: the same pairs as by trying all, and no box in more than a few cells."""
    r = np.random.default_rng(5)
    boxes = [("p", f"b{i:03}", float(x), float(y), float(w), float(h)) for i, (x, y, w, h) in enumerate(zip(r.integers(0, 9000, 60), r.integers(0, 9000, 60), 2 ** r.uniform(0, 13, 60), 2 ** r.uniform(0, 13, 60), strict=True))]
    boxes += [("p", "huge1", 0.0, 0.0, 100000.0, 100000.0), ("p", "huge2", 10.0, 10.0, 99000.0, 50.0), ("p", "inf", 0.0, 0.0, float("inf"), 1.0), ("p", "nan", float("nan"), 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "page string, k string, x double, y double, width double, height double").select("page", "k", F.struct("x", "y", "width", "height").alias("bbox"))
    got = {(x["id_a"], x["id_b"]) for x in regions.self_pairs(df, ["page"], "k").collect()}
    live = [b for b in boxes if all(abs(v) < 1e15 for v in b[2:])]
    want = {(a[1], b[1]) for a, b in itertools.combinations(sorted(live, key=lambda t: t[1]), 2) if min(a[2] + a[4], b[2] + b[4]) > max(a[2], b[2]) and min(a[3] + a[5], b[3] + b[5]) > max(a[3], b[3])}
    assert got == want
    assert df.select(F.size(regions._cells(F.col("bbox"), regions._level(F.col("bbox")))).alias("n")).agg(F.max("n")).first()[0] <= 4
