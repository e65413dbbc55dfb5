"""Queries over boxes: canonical form, overlaps, merging, suppression, matching, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import geometry as G
from veilmark.operators import regions, telemetry, vision
from veilmark.plans import sqltext as S
from veilmark.sources import table


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_requests").dropDuplicates(["request_id"])


def _redactions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the requests: page is the request."""
    r = _requests(spark, d).select("request_id", F.posexplode("redactions").alias("ord", "r")).filter(F.col("r").isNotNull())
    return r.select(
        F.col("request_id").alias("page_id"), "ord", F.concat_ws("-", F.lit("r"), F.lpad(F.col("ord").cast("string"), 4, "0")).alias("box_id"), F.col("r.region_id").alias("region_id"), F.col("r.type").alias("type"), F.col("r.bbox").alias("bbox"),
        F.lit(None).cast("double").alias("confidence"), F.col("r.severity").alias("severity"), F.col("r.treatment").alias("redaction"), F.col("r.source").alias("source"),
    )


def _dom(spark: SparkSession, d: str) -> DataFrame:
    r = _requests(spark, d).select("request_id", F.posexplode("dom").alias("ord", "e")).filter(F.col("e").isNotNull())
    return r.select(F.col("request_id").alias("page_id"), "ord", F.concat_ws("-", F.lit("e"), F.lpad(F.col("ord").cast("string"), 5, "0")).alias("element_id"), G.canonical(F.col("e.bbox")).alias("bbox"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from order lines: one page an order of few customers' worth, so boxes do overlap."""
    b = F.struct(((F.col("l_partkey") % 40) * 5.0).alias("x"), ((F.col("l_suppkey") * 7) % 120).cast("double").alias("y"), (F.lit(60.0) + F.col("l_quantity")).cast("double").alias("width"), (F.lit(30.0) + F.col("l_linenumber") * 5).cast("double").alias("height"))
    rows = table(spark, d, "lineitem").select((F.floor(F.col("l_orderkey") / 4)).cast("string").alias("page_id"), F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.col("l_linenumber").cast("string")).alias("box_id"), b.alias("bbox"), "l_extendedprice")
    rows = rows.dropDuplicates(["box_id"])
    return rows.withColumn("score", F.round((F.col("l_extendedprice") % 1000) / 1000, 4).cast("double"))


def bbox_canonical(spark: SparkSession, d: str) -> DataFrame:
    r = regions.canonical(_redactions(spark, d))
    return r.select("page_id", "ord", "type", "severity", "redaction", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.width").alias("width"), F.col("bbox.height").alias("height"))


def bbox_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs with their measures."""
    p = regions.self_pairs(_boxes(spark, d), ["page_id"], "box_id")
    return p.select("page_id", "id_a", "id_b", F.floor(F.col("iou") * 10000).cast("int").alias("iou_e4"), F.floor(F.col("containment") * 10000).cast("int").alias("containment_e4"), F.round("intersection", 3).alias("intersection"))


def bbox_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    p = regions.self_pairs(_boxes(spark, d), ["page_id"], "box_id")
    return p.groupBy(F.floor(F.col("iou") * 10).cast("int").alias("iou_tenth")).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("containment") >= regions.CONTAINMENT_MERGE).alias("n_contained"))


def dom_vision_match(spark: SparkSession, d: str) -> DataFrame:
    """Elements of a request with the redaction box that overlaps them best, and the boxes nobody took."""
    vis = regions.canonical(_redactions(spark, d)).select("page_id", F.col("box_id").alias("detection_id"), "ord", "bbox", "confidence")
    m = regions.match_detections(_dom(spark, d), vis, ["page_id"])
    return m.withColumn("iou", F.round("iou", 6)).drop("confidence")


def unmatched_detections(spark: SparkSession, d: str) -> DataFrame:
    return dom_vision_match(spark, d).filter(F.col("source") == "vision").select("page_id", "detection_id")


def point_hits(spark: SparkSession, d: str) -> DataFrame:
    """The element under the centre of each redaction."""
    r = regions.canonical(_redactions(spark, d))
    points = r.select("page_id", F.col("box_id").alias("point_id"), (F.col("bbox.x") + F.col("bbox.width") / 2).alias("px"), (F.col("bbox.y") + F.col("bbox.height") / 2).alias("py"))
    return regions.hit(points, _dom(spark, d), ["page_id"])


def region_hulls(spark: SparkSession, d: str) -> DataFrame:
    """Regions of a request and type merged to their hull."""
    return regions.hulls(regions.canonical(_redactions(spark, d)), ["page_id", "type"])


def region_order(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each region within its request: severity, area, position."""
    from pyspark.sql import Window

    r = regions.canonical(_redactions(spark, d))
    rank = regions._map({"low": 1, "medium": 2, "high": 3, "critical": 4})[F.col("severity")]
    w = Window.partitionBy("page_id").orderBy(rank.desc(), (F.col("bbox.width") * F.col("bbox.height")).desc(), "ord")
    return r.select("page_id", "ord", F.row_number().over(w).alias("rank"))


def region_merge(spark: SparkSession, d: str) -> DataFrame:
    r = regions.canonical(_redactions(spark, d)).withColumn("region_id", F.concat_ws("_", "region_id", "ord"))
    return regions.merge_regions(r, "page_id").withColumn("n_merged", F.size("merged_from")).drop("merged_from")


def nms_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that survive greedy suppression."""
    b = _boxes(spark, d).withColumn("ord", F.col("box_id"))
    return regions.nms(b, ["page_id"], vision.OVERLAP)


def priors_grid(spark: SparkSession, d: str) -> DataFrame:
    p = vision.priors(spark)
    return p.select("ord", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


def priors_by_stride(spark: SparkSession, d: str) -> DataFrame:
    p = vision.priors(spark)
    return p.groupBy(F.round("w", 6).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("cx"), 6).alias("min_cx"), F.round(F.max("cy"), 6).alias("max_cy"))


def decoded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes decoded from priors and offsets made of order lines."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4420).cast("int").alias("ord"), *[((F.col(c) % 11) - 5.0).cast("double").alias(n) for c, n in (("l_suppkey", "dx"), ("l_partkey", "dy"), ("l_quantity", "dw"), ("l_linenumber", "dh"))])
    # 4420 rows, whatever the input
    j = rows.join(F.broadcast(vision.priors(spark)), "ord")
    box = vision.decode({c: F.col(c) for c in ("cx", "cy", "w", "h")}, {c: F.col(c) for c in ("dx", "dy", "dw", "dh")}, F.lit(800.0), F.lit(600.0))
    return j.select("l_orderkey", "l_linenumber", *[F.round(v, 4).alias(k) for k, v in box.items()])


def text_bands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of hours with a high mean value, per event type."""
    e = table(spark, d, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour")).agg(F.avg("value").alias("v"))
    mean = e.groupBy("event_type").agg(F.avg("v").alias("m"))
    j = e.join(F.broadcast(mean), "event_type").withColumn("high", F.round(F.col("v") - F.col("m"), 6) > 0)
    return telemetry.islands(j, ["event_type"], "hour", F.col("high")).withColumn("island", F.col("island").cast("int"))


_NUM = "CASE WHEN {v} IS NULL OR isnan({v}) THEN {low} ELSE greatest({low}, least(100000.0, floor(greatest(-100000.0, least(100000.0, {v})) + 0.5))) END"
_CANON = ", ".join(f"{_NUM.format(v='b.' + c, low=low)} AS {c}" for c, low in (("x", "0.0"), ("y", "0.0"), ("width", "1.0"), ("height", "1.0")))
_RED = f"""q AS {S.REQUESTS}, r0 AS (SELECT request_id AS page_id, unnest(range(len(redactions))) AS ord, unnest(redactions) AS r FROM q),
red AS (SELECT page_id, CAST(ord AS INTEGER) AS ord, 'r-' || lpad(CAST(ord AS VARCHAR), 4, '0') AS box_id, r.type AS type, r.source AS source,
coalesce(r.severity, CASE r.type WHEN 'password' THEN 'critical' WHEN 'secret' THEN 'critical' WHEN 'api_key' THEN 'high' WHEN 'credit_card' THEN 'high' WHEN 'id' THEN 'high' WHEN 'address' THEN 'low' WHEN 'name' THEN 'low' ELSE 'medium' END) AS severity,
CASE WHEN r.treatment IN ('blur', 'mask', 'blackout') THEN r.treatment WHEN r.type IN ('password', 'secret', 'sensitive') THEN 'blackout' WHEN r.type = 'face' THEN 'blur' WHEN r.type IN ('api_key', 'credit_card', 'id', 'email', 'phone', 'address', 'name') THEN 'mask' ELSE 'blackout' END AS redaction, r.bbox AS b FROM r0 WHERE r IS NOT NULL),
can AS (SELECT * EXCLUDE (b), {_CANON} FROM red)"""
_DOM = f"""d0 AS (SELECT request_id AS page_id, unnest(range(len(dom))) AS ord, unnest(dom) AS e FROM q),
dom AS (SELECT page_id, CAST(ord AS INTEGER) AS ord, 'e-' || lpad(CAST(ord AS VARCHAR), 5, '0') AS element_id, {_CANON.replace('b.', 'e.bbox.')} FROM d0 WHERE e IS NOT NULL)"""
_BOX = """b AS (SELECT DISTINCT ON (box_id) * FROM (SELECT CAST(CAST(floor(l_orderkey / 4) AS BIGINT) AS VARCHAR) AS page_id, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || CAST(l_linenumber AS VARCHAR) AS box_id,
(l_partkey % 40) * 5.0::DOUBLE AS x, CAST((l_suppkey * 7) % 120 AS DOUBLE) AS y, CAST(60 + l_quantity AS DOUBLE) AS width, CAST(30 + l_linenumber * 5 AS DOUBLE) AS height, round(CAST(l_extendedprice % 1000 AS DOUBLE) / 1000, 4) AS score FROM lineitem))"""


def _inter(a: str, b: str) -> str:
    return f"greatest(least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x), 0.0) * greatest(least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y), 0.0)"


def _iou(a: str, b: str) -> str:
    return f"({_inter(a, b)}) / ({a}.width * {a}.height + {b}.width * {b}.height - {_inter(a, b)})"


_PAIRS = f"""WITH {_BOX}, p AS (SELECT a.page_id, a.box_id AS id_a, c.box_id AS id_b, {_iou('a', 'c')} AS iou, {_inter('a', 'c')} / least(a.width * a.height, c.width * c.height) AS containment, {_inter('a', 'c')} AS intersection
FROM b a JOIN b c ON a.page_id = c.page_id AND a.box_id < c.box_id WHERE {_inter('a', 'c')} > 0)"""
_MATCH = f"""WITH {_RED}, {_DOM}, m AS (SELECT dom.page_id, dom.element_id, can.box_id, can.ord, {_iou('dom', 'can')} AS iou FROM dom JOIN can ON dom.page_id = can.page_id WHERE {_iou('dom', 'can')} > 0.3),
best AS (SELECT page_id, element_id, box_id, iou FROM m QUALIFY row_number() OVER (PARTITION BY page_id, element_id ORDER BY iou DESC, ord) = 1),
res AS (SELECT dom.page_id, dom.element_id, best.box_id AS detection_id, round(best.iou, 6) AS iou, CASE WHEN best.box_id IS NULL THEN 'dom' ELSE 'merged' END AS source FROM dom LEFT JOIN best ON dom.page_id = best.page_id AND dom.element_id = best.element_id
UNION ALL SELECT can.page_id, NULL, can.box_id, NULL, 'vision' FROM can WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.page_id = can.page_id AND best.box_id = can.box_id))"""
_PRIORS = """pr AS (SELECT CAST(row_number() OVER (ORDER BY level, i, j, k) - 1 AS INTEGER) AS ord, least(greatest((j + 0.5) * stride / 320.0, 0.0), 1.0)::DOUBLE AS cx, least(greatest((i + 0.5) * stride / 240.0, 0.0), 1.0)::DOUBLE AS cy, least(box / 320.0, 1.0)::DOUBLE AS w, least(box / 240.0, 1.0)::DOUBLE AS h FROM (
SELECT level, stride, i, j, unnest(range(len(boxes))) AS k, unnest(boxes) AS box FROM (SELECT level, stride, boxes, unnest(range(CAST(ceil(240.0 / stride) AS BIGINT))) AS i, cols FROM (SELECT *, CAST(ceil(320.0 / stride) AS BIGINT) AS cols FROM (VALUES (0, 8, [10, 16, 24]), (1, 16, [32, 48]), (2, 32, [64, 96]), (3, 64, [128, 192, 256])) t(level, stride, boxes))), LATERAL (SELECT unnest(range(cols)) AS j)))"""

QUERIES = {f.__name__: f for f in (bbox_canonical, bbox_pairs, bbox_pair_counts, dom_vision_match, unmatched_detections, point_hits, region_hulls, region_order, region_merge, nms_boxes, priors_grid, priors_by_stride, decoded_boxes, text_bands)}

ORACLES = {
    "bbox_canonical": f"WITH {_RED} SELECT page_id, ord, type, severity, redaction, x, y, width, height FROM can",
    "bbox_pairs": _PAIRS + " SELECT page_id, id_a, id_b, CAST(floor(iou * 10000) AS INTEGER) AS iou_e4, CAST(floor(containment * 10000) AS INTEGER) AS containment_e4, round(intersection, 3) AS intersection FROM p",
    "bbox_pair_counts": _PAIRS + " SELECT CAST(floor(iou * 10) AS INTEGER) AS iou_tenth, count(*) AS n_pairs, count(*) FILTER (containment >= 0.6) AS n_contained FROM p GROUP BY 1",
    "dom_vision_match": _MATCH + " SELECT * FROM res",
    "unmatched_detections": _MATCH + " SELECT page_id, detection_id FROM res WHERE source = 'vision'",
    "point_hits": f"""WITH {_RED}, {_DOM}, h AS (SELECT can.page_id, can.box_id AS point_id, dom.element_id FROM can JOIN dom ON can.page_id = dom.page_id AND can.x + can.width / 2 BETWEEN dom.x AND dom.x + dom.width AND can.y + can.height / 2 BETWEEN dom.y AND dom.y + dom.height
QUALIFY row_number() OVER (PARTITION BY can.page_id, can.box_id ORDER BY dom.ord) = 1) SELECT can.page_id, can.box_id AS point_id, h.element_id FROM can LEFT JOIN h ON can.page_id = h.page_id AND can.box_id = h.point_id""",
    "region_hulls": f"""WITH {_RED}, k AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END AS sr, CASE redaction WHEN 'blur' THEN 1 WHEN 'mask' THEN 2 ELSE 3 END AS rr FROM can)
SELECT page_id, type, arg_max(severity, sr) AS severity, arg_max(redaction, rr) AS redaction, 0.5::DOUBLE AS confidence, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources, count(*) AS n_regions FROM k GROUP BY page_id, type""",
    "region_order": f"""WITH {_RED} SELECT page_id, ord, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END DESC, width * height DESC, ord) AS INTEGER) AS rank FROM can""",
    "nms_boxes": f"""WITH RECURSIVE {_BOX}, o AS (SELECT page_id, list({{'id': box_id, 'x': x, 'y': y, 'width': width, 'height': height}} ORDER BY score DESC, box_id) AS l FROM b GROUP BY page_id)
SELECT page_id, unnest(list_transform(list_reduce(list_prepend([]::STRUCT(id VARCHAR, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE)[], list_transform(l, lambda c: [c])), lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: {_iou('k', 'c[1]')} > 0.3)) > 0 THEN acc ELSE list_concat(acc, c) END), lambda z: z.id)) AS box_id FROM o""",
    "priors_grid": f"WITH {_PRIORS} SELECT ord, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM pr",
    "priors_by_stride": f"WITH {_PRIORS} SELECT round(w, 6) AS w, count(*) AS n, round(min(cx), 6) AS min_cx, round(max(cy), 6) AS max_cy FROM pr GROUP BY 1",
    "decoded_boxes": f"""WITH {_PRIORS}, l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 4420 AS INTEGER) AS ord, (l_suppkey % 11) - 5.0 AS dx, (l_partkey % 11) - 5.0 AS dy, CAST(l_quantity % 11 AS DOUBLE) - 5.0 AS dw, (l_linenumber % 11) - 5.0 AS dh FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, cx + dx * 0.1 * w AS cx, cy + dy * 0.1 * h AS cy, w * exp(dw * 0.2) AS w, h * exp(dh * 0.2) AS h FROM l JOIN pr USING (ord)),
k AS (SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, cx - w / 2)) AS x1, greatest(0.0, least(1.0, cy - h / 2)) AS y1, greatest(0.0, least(1.0, cx + w / 2)) AS x2, greatest(0.0, least(1.0, cy + h / 2)) AS y2 FROM c)
SELECT l_orderkey, l_linenumber, round(x1 * 800, 4) AS x, round(y1 * 600, 4) AS y, round((x2 - x1) * 800, 4) AS width, round((y2 - y1) * 600, 4) AS height FROM k""",
    "text_bands": """WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT event_type, avg(v) AS m FROM e GROUP BY 1),
f AS (SELECT event_type, hour, round(v - m, 6) > 0 AS high FROM e JOIN m USING (event_type)), g AS (SELECT *, CASE WHEN high AND NOT coalesce(lag(high) OVER (PARTITION BY event_type ORDER BY hour), false) THEN 1 ELSE 0 END AS new FROM f),
i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY hour) AS island FROM g) SELECT event_type, CAST(island AS INTEGER) AS island, min(hour) AS first, max(hour) AS last, count(*) AS n FROM i WHERE high GROUP BY 1, 2""",
}
