"""Regions: canonical form, overlap, merging, suppression, matching with detections.

Pairs are found within a page through a grid: boxes are exploded to the cells they touch and joined on page and cell,
each pair once, so a page with many boxes is no quadratic join. The greedy merge depends on order and runs per page
over all regions of that page, however many; its time grows with their square.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import geometry as G
from veilmark.functions import patterns as P

CELL = 200.0
IOU_MERGE, CONTAINMENT_MERGE, MATCH_IOU, MAX_PASSES = 0.15, 0.6, 0.3, 20


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def canonical(regions: DataFrame) -> DataFrame:
    """Boxes, confidences and enumerations in their canonical form; defaults by type."""
    severity = F.coalesce(F.col("severity"), _map(P.SEVERITY_OF)[F.col("type")], F.lit("medium")) if "severity" in regions.columns else F.coalesce(_map(P.SEVERITY_OF)[F.col("type")], F.lit("medium"))
    default = F.coalesce(_map(P.REDACTION_OF)[F.col("type")], F.when(F.col("type").isin(*P.KNOWN_TYPES), F.lit("mask")).otherwise(F.lit("blackout")))
    redaction = F.when(F.col("redaction").isin(*P.REDACTION_RANK), F.col("redaction")).otherwise(default)
    return regions.withColumns({"bbox": G.canonical(F.col("bbox")), "confidence": G.confidence(F.col("confidence")), "severity": severity, "redaction": redaction})


LEVELS = 11


def _extent(b: Column) -> Column:
    return F.greatest(b["width"], b["height"], F.lit(0.0))


def _finite(b: Column) -> Column:
    return F.forall(F.array(b["x"], b["y"], b["width"], b["height"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15))


def _level(b: Column) -> Column:
    """The finest grid whose cells are as long as a box: it then touches four of them at most. The coarsest takes all larger ones."""
    return F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(_extent(b), F.lit(1.0)) / CELL)))).cast("int")


def _cells(b: Column, level: Column) -> Column:
    """Cells of a level that a box touches; none where it is not finite."""
    size = F.lit(CELL) * F.pow(F.lit(2.0), level)

    def span(low: Column, extent: Column) -> Column:
        return F.sequence(F.floor(low / size), F.floor((low + F.greatest(extent, F.lit(0.0))) / size))

    cells = F.flatten(F.transform(span(b["x"], b["width"]), lambda cx: F.transform(span(b["y"], b["height"]), lambda cy: F.struct(level.alias("level"), cx.alias("cx"), cy.alias("cy")))))
    return F.when(_finite(b), cells)


def _first_cell(a: Column, b: Column, level: Column) -> Column:
    """The lowest cell of a level two overlapping boxes share: where their pair is kept, once."""
    size = F.lit(CELL) * F.pow(F.lit(2.0), level)
    return F.struct(level.alias("level"), F.floor(F.greatest(a["x"], b["x"]) / size).alias("cx"), F.floor(F.greatest(a["y"], b["y"]) / size).alias("cy"))


def _placed(rows: DataFrame, page: Sequence[str], key: str, name: str, others: DataFrame) -> DataFrame:
    """(page, key, box, own, cell): a box on its own level, and on the coarser levels where the page's others have one."""
    at = others.select(*page, _level(F.col("bbox")).alias("l")).distinct().groupBy(*page).agg(F.collect_set("l").alias("levels"))
    own = _level(F.col("bbox"))
    rows = rows.join(at, list(page)).withColumn("own", own)
    levels = F.array_union(F.array("own"), F.filter("levels", lambda v: v > F.col("own")))
    return rows.select(*page, F.col(key), F.col("bbox").alias(name), F.col("own").alias(f"own_{name}"), F.explode(F.flatten(F.transform(levels, lambda v: F.coalesce(_cells(F.col("bbox"), v), F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>"))))).alias("cell"))


def overlapping(left: DataFrame, right: DataFrame, page: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs of boxes of a page that share area: (page, left_id, right_id, iou, containment, intersection).

    Two boxes meet on the level of the larger one, in the lowest cell they share. A box touches few cells of its own
    level and of coarser ones, so a page-sized box does not multiply.
    """
    a, b = _placed(left, page, left_id, "a", right), _placed(right, page, right_id, "b", left)
    rows = a.join(b, [*page, "cell"]).filter(F.col("cell.level") == F.greatest("own_a", "own_b")).filter(F.col("cell") == _first_cell(F.col("a"), F.col("b"), F.col("cell.level")))
    rows = rows.select(*page, left_id, right_id, G.iou(F.col("a"), F.col("b")).alias("iou"), G.containment(F.col("a"), F.col("b")).alias("containment"), G.intersection(F.col("a"), F.col("b")).alias("intersection"))
    return rows.filter(F.col("intersection") > 0)


def self_pairs(regions: DataFrame, page: Sequence[str], key: str) -> DataFrame:
    """Each overlapping pair of a page once, the smaller key first."""
    return overlapping(regions.withColumnRenamed(key, "id_a"), regions.withColumnRenamed(key, "id_b"), page, "id_a", "id_b").filter(F.col("id_a") < F.col("id_b"))


def match_detections(elements: DataFrame, detections: DataFrame, page: Sequence[str], threshold: float = MATCH_IOU) -> DataFrame:
    """Elements with the detection that overlaps them best (ties: the earliest), then the detections nobody took.

    elements: page, element_id, bbox; detections: page, detection_id, ord, bbox, confidence.
    Result: page, element_id, detection_id, confidence, iou, source (merged, dom, vision).
    """
    pairs = overlapping(elements, detections, page, "element_id", "detection_id").filter(F.col("iou") > threshold)
    pairs = pairs.join(detections.select(*page, "detection_id", "ord", "confidence"), [*page, "detection_id"])
    best = pairs.groupBy(*page, "element_id").agg(F.min_by(F.struct("detection_id", "confidence", "iou"), F.struct((-F.col("iou")).alias("i"), "ord")).alias("m"))
    matched = elements.select(*page, "element_id").join(best, [*page, "element_id"], "left").select(
        *page, "element_id", "m.detection_id", "m.confidence", "m.iou", F.when(F.col("m").isNull(), "dom").otherwise("merged").alias("source")
    )
    free = detections.join(best.select(*page, "m.detection_id"), [*page, "detection_id"], "left_anti")
    return matched.unionByName(free.select(*page, F.lit(None).cast("string").alias("element_id"), "detection_id", "confidence", F.lit(None).cast("double").alias("iou"), F.lit("vision").alias("source")))


def hit(points: DataFrame, elements: DataFrame, page: Sequence[str]) -> DataFrame:
    """For each point (page, point_id, px, py) the first element by ord whose box contains it, bounds included."""
    own = _level(F.col("bbox"))
    e = elements.select(*page, "element_id", "ord", "bbox", F.explode(_cells(F.col("bbox"), own)).alias("cell"))
    # a point lies in one cell of each level
    level = lambda i: F.struct(i.cast("int").alias("level"), F.floor(F.col("px") / (F.lit(CELL) * F.pow(F.lit(2.0), i))).alias("cx"), F.floor(F.col("py") / (F.lit(CELL) * F.pow(F.lit(2.0), i))).alias("cy"))
    rows = points.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level))).join(e, [*page, "cell"]).filter(G.contains(F.col("bbox"), F.col("px"), F.col("py")))
    first = rows.groupBy(*page, "point_id").agg(F.min_by("element_id", F.struct("ord", "element_id")).alias("element_id"))
    return points.select(*page, "point_id").join(first, [*page, "point_id"], "left")


def hulls(regions: DataFrame, cluster: Sequence[str]) -> DataFrame:
    """One merged region a cluster: the hull, the highest severity, the strongest redaction, the sources together."""
    severity, strength = _map(P.SEVERITY_RANK), _map(P.REDACTION_RANK)
    rows = regions.withColumns({"sr": severity[F.col("severity")], "rr": strength[F.col("redaction")], "x": F.col("bbox.x"), "y": F.col("bbox.y"), "r": F.col("bbox.x") + F.col("bbox.width"), "b": F.col("bbox.y") + F.col("bbox.height")})
    top = F.struct("sr", (-F.col("ord")).alias("o"))
    kept = [] if "type" in cluster else [F.max_by("type", top).alias("type")]
    return rows.groupBy(*cluster).agg(
        *kept, F.max_by("severity", "sr").alias("severity"), F.max_by("redaction", "rr").alias("redaction"), F.max("confidence").alias("confidence"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("r") - F.min("x")).alias("width"), (F.max("b") - F.min("y")).alias("height"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.count(F.lit(1)).alias("n_regions"),
    )


def nms(boxes: DataFrame, page: Sequence[str], threshold: float) -> DataFrame:
    """Greedy suppression: a box stays unless one that stayed, of higher score (ties: earlier), overlaps it by more than threshold.

    A fold over the page's boxes in order of score, as kept boxes never change. boxes: page, box_id, ord, score, bbox.
    A page is one image's output, at most the number of priors (4420): that bounds what is collected.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "box_id", "bbox")))
    kind = "array<struct<box_id:string,x:double,y:double,width:double,height:double>>"

    def step(kept: Column, c: Column) -> Column:
        here = F.struct(c["box_id"].alias("box_id"), c["bbox"]["x"].alias("x"), c["bbox"]["y"].alias("y"), c["bbox"]["width"].alias("width"), c["bbox"]["height"].alias("height"))
        return F.when(F.exists(kept, lambda k: G.iou(k, c["bbox"]) > threshold), kept).otherwise(F.concat(kept, F.array(here)))

    kept = boxes.groupBy(*page).agg(ordered.alias("o")).select(*page, F.explode(F.aggregate("o", F.array().cast(kind), step)).alias("k"))
    return kept.select(*page, "k.box_id")


def _overlap(a: list, b: list) -> tuple[float, float]:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(w, 0.0) * max(h, 0.0)
    aa, bb = a[2] * a[3], b[2] * b[3]
    union, least = aa + bb - inter, min(aa, bb)
    return (inter / union if aa > 0 and bb > 0 and union > 0 else 0.0), (inter / least if least > 0 else 0.0)


def _united(a: dict, b: dict) -> dict:
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    right, bottom = max(a["x"] + a["width"], b["x"] + b["width"]), max(a["y"] + a["height"], b["y"] + b["height"])
    first, second = (a, b) if P.SEVERITY_RANK[a["severity"]] >= P.SEVERITY_RANK[b["severity"]] else (b, a)
    return {
        **first, "x": x, "y": y, "width": right - x, "height": bottom - y, "confidence": max(a["confidence"], b["confidence"]), "severity": first["severity"],
        "redaction": max(a["redaction"], b["redaction"], key=P.REDACTION_RANK.__getitem__), "region_id": f"merged_{first['region_id']}_{second['region_id']}"[:64],
        "merged_from": list(dict.fromkeys([*a["merged_from"], *b["merged_from"]])),
    }


def merge_page(regions: list[dict], iou: float = IOU_MERGE, contained: float = CONTAINMENT_MERGE) -> list[dict]:
    """Greedy merge of one page's canonical regions to a fixpoint, at most MAX_PASSES passes.

    Regions are taken by severity, confidence, area and id; each takes up every later one that overlaps it enough or
    has its id, growing as it goes; passes repeat until nothing merges.
    """
    current = regions
    for _ in range(MAX_PASSES):
        order = sorted(current, key=lambda r: (-P.SEVERITY_RANK[r["severity"]], -r["confidence"], -r["width"] * r["height"], r["region_id"]))
        out: list[dict] = []
        taken = [False] * len(order)
        for i, base in enumerate(order):
            if taken[i]:
                continue
            for j in range(i + 1, len(order)):
                if taken[j]:
                    continue
                other = order[j]
                o, c = _overlap([base["x"], base["y"], base["width"], base["height"]], [other["x"], other["y"], other["width"], other["height"]])
                if o >= iou or c >= contained or base["region_id"] == other["region_id"]:
                    base = _united(base, other)
                    taken[j] = True
            out.append(base)
        if len(out) == len(current):
            return out
        current = out
    return current


def merge_regions(regions: DataFrame, page: str) -> DataFrame:
    """merge_page for every page. regions: page, region_id, type, bbox, confidence, severity, redaction (canonical).

    Pages are merged in a stream of sorted rows: one page is held at a time, and no frame is built for each.
    """
    schema = f"{page} string, region_id string, type string, x double, y double, width double, height double, confidence double, severity string, redaction string, merged_from array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    flat = regions.select(page, "region_id", "type", "bbox.x", "bbox.y", "bbox.width", "bbox.height", "confidence", "severity", "redaction")

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, [], []
        for batch in batches:
            for r in batch.to_dict("records"):
                if r[page] != at:
                    out.extend(merge_page(held))
                    at, held = r[page], []
                    if len(out) >= 4096:
                        yield pd.DataFrame(out)[names]
                        out = []
                held.append({**r, "merged_from": [r["region_id"]]})
        out.extend(merge_page(held))
        if out:
            yield pd.DataFrame(out)[names]

    return flat.repartition(page).sortWithinPartitions(page, "region_id").mapInPandas(flow, schema)
