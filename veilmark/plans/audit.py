"""Queries of the audit: reports, allow-lists, deep scans, payload sizes, detector output end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions import text as X
from veilmark.functions import sql, urls
from veilmark.operators import detectors, evaluation, regions, telemetry, vision
from veilmark.plans import sqltext as S
from veilmark.sources import corpus, table

ALLOWED = ("pageState", "elements")
#: Keys that name raw data by themselves (fixed values).
SUSPICIOUS = ("rawpassword", "raw_password", "raw_pwd", "rawsecret", "raw_secret", "rawdom", "raw_dom", "rawscreenshot", "raw_screenshot", "unredacted", "plaintext")
#: Keys of the payload's own structure: their values are searched for private and API keys only (fixed values).
STRUCTURAL = ("id", "element_id", "tag", "role", "semanticRole", "source", "treatment", "severity", "policy_version", "version", "ruleId", "detector", "rawType", "action", "type")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_requests").dropDuplicates(["request_id"])


def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the audit: requests, refusable ones, regions by type folded."""
    r = _requests(spark, d)
    reg = r.select(F.explode("redactions").alias("x")).filter(F.col("x").isNotNull()).select(F.col("x.type").alias("type"))
    kinds = telemetry.type_counts(reg).select(F.concat(F.lit("regions_"), "type").alias("metric"), "n")
    bad = ~(F.coalesce("privacy.sanitized", F.lit(False)) & F.coalesce("privacy.raw_data_removed", F.lit(False)))
    totals = r.agg(F.count(F.lit(1)).alias("requests"), F.count_if(bad).alias("unsanitised"), F.count_if(F.size("redactions") > 0).alias("with_regions"))
    long = totals.unpivot([], ["requests", "unsanitised", "with_regions"], "metric", "n")
    return long.unionByName(kinds)


def scan_latency(spark: SparkSession, d: str) -> DataFrame:
    """Scan time of requests by number of elements."""
    n = F.coalesce(F.size("dom"), F.lit(0))
    band = F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 100, "11-100").otherwise("over 100")
    ok = F.col("privacy.scan_ms").isNotNull() & ~F.isnan("privacy.scan_ms")
    return _requests(spark, d).filter(ok).groupBy(band.alias("elements")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("privacy.scan_ms"), 4).alias("mean_ms"), F.max("privacy.scan_ms").alias("max_ms"))


def unexpected_fields(spark: SparkSession, d: str) -> DataFrame:
    """Top-level keys of the payloads that are not allowed."""
    c = table(spark, d, "capture_records").filter(F.col("payload").isNotNull())
    keys = F.array_except(F.json_object_keys("payload"), F.array(*[F.lit(k) for k in ALLOWED]))
    return c.agg(F.count(F.lit(1)).alias("n_payloads"), F.count_if(F.size(keys) > 0).alias("n_unexpected"))


def region_ids(spark: SparkSession, d: str) -> DataFrame:
    """Regions by whether their id names one of their elements."""
    r = _requests(spark, d).select(F.explode("redactions").alias("x")).filter(F.col("x").isNotNull())
    named = F.coalesce(F.exists("x.element_ids", lambda e: F.contains("x.region_id", e)), F.lit(False))
    return r.groupBy(F.col("x.source").alias("source"), named.alias("named")).agg(F.count(F.lit(1)).alias("n"))


def region_sources_merged(spark: SparkSession, d: str) -> DataFrame:
    """Distinct origins of a request's regions, as one list."""
    r = _requests(spark, d).select("request_id", F.explode("redactions").alias("x")).filter(F.col("x").isNotNull())
    all_of = F.array_distinct(F.array_sort(F.flatten(F.collect_list(F.coalesce("x.provenance.merged_from", F.array().cast("array<string>"))))))
    return r.groupBy("request_id").agg(F.array_join(all_of, "|").alias("merged_from"), F.count(F.lit(1)).alias("n"))


def _nesting(payload: Column) -> Column:
    """Levels of objects and arrays in a JSON text."""
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(payload, r"(?s)\\.", ""), r'"[^"]*"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: X.let(a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1), lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most")))
    return F.when(marks != "", F.aggregate(F.split(marks, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])).otherwise(0)


def deep_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every string of the payloads at any depth with a rule it breaks, counted by path and code.

    The payload is walked level by level as a variant, as many levels as the deepest payload has: objects and arrays
    are exploded, strings kept and judged at the end.
    """
    c = table(spark, d, "capture_records").select("payload", F.try_parse_json("payload").alias("v")).filter(F.col("v").isNotNull())
    depth = c.agg(F.max(_nesting(F.col("payload")))).first()[0] or 0
    level = c.select(F.lit("").alias("path"), F.lit("").alias("key"), "v")
    for _ in range(depth):
        kind, path = F.schema_of_variant("v"), F.col("path")
        node = lambda p, k, v: F.struct(p.alias("path"), k.alias("key"), v.alias("v"))
        objects = F.transform(F.map_entries(F.variant_get("v", "$", "map<string,variant>")), lambda e: node(F.concat_ws(".", F.nullif(path, F.lit("")), e["key"]), e["key"], e["value"]))
        lists = F.transform(F.variant_get("v", "$", "array<variant>"), lambda v: node(F.concat(path, F.lit("[]")), F.lit(""), v))
        level = level.select(F.explode(F.when(kind.startswith("OBJECT"), objects).when(kind.startswith("ARRAY"), lists).when(kind == "STRING", F.array(node(path, F.col("key"), F.col("v"))))).alias("x")).select("x.*")
    found = level.filter(F.schema_of_variant("v") == "STRING").select("path", "key", F.trim(F.variant_get("v", "$", "string")).alias("s"))
    s = F.col("s")
    secret = X.matches(s, P.PRIVATE_KEY) | X.matches(s, P.API_KEY)
    code = (
        F.when(X.contains_any(F.col("key"), SUSPICIOUS), "SUSPICIOUS_KEY_NAME").when(F.col("key").isin(*STRUCTURAL), F.when(secret, "LEAKED_SECRET").otherwise("none"))
        .when(X.matches(s, P.PRIVATE_KEY), "LEAKED_PRIVATE_KEY").when(X.matches(s, P.API_KEY), "LEAKED_API_KEY").when(X.matches(s, P.CARD_LOOSE), "LEAKED_CREDIT_CARD")
        .when(X.matches(s, P.EMAIL), "LEAKED_EMAIL").when(X.matches(s, P.PHONE), "LEAKED_PHONE").when(X.matches(s, P.NATIONAL_ID), "LEAKED_NATIONAL_ID").when(urls.is_sensitive(s), "SENSITIVE_URL_PARAM").otherwise("none")
    )
    return found.filter((s != "") & (s != P.REDACTED)).groupBy("path", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def payload_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the records as delivered, by producer."""
    c = table(spark, d, "capture_records").filter(F.col("payload").isNotNull())
    return c.groupBy("producer_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.max(F.octet_length("payload")).alias("largest"))


def history_lines(spark: SparkSession, d: str) -> DataFrame:
    """The history of a request as one text, a line a step, in order."""
    s = _requests(spark, d).filter(F.size("step_history") > 0)
    line = lambda x: F.concat(F.lit("Step "), F.coalesce(x["step"].cast("string"), F.lit("?")), F.lit(": "), F.coalesce(x["action"]["action"], F.lit("-")), F.when(x["action"]["target"].isNotNull(), F.concat(F.lit(" target="), x["action"]["target"])).otherwise(F.lit("")))
    text = F.array_join(F.transform(F.filter("step_history", lambda x: x.isNotNull()), line), "\n")
    return s.select("request_id", text.alias("history"), F.regexp_count(text, F.lit("Step")).alias("n_steps"))


def detector_output(spark: SparkSession, d: str) -> DataFrame:
    """Scores and offsets to boxes end to end: threshold, decoding, suppression. Made of order lines, a page an order."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("page_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("box_id"), F.col("l_linenumber").alias("lord"), (F.col("l_partkey") % 4420).cast("int").alias("ord"), ((F.col("l_suppkey") % 100) / 100).cast("double").alias("score"),
        *[((F.col(c) % 11) - 5.0).cast("double").alias(n) for c, n in (("l_suppkey", "dx"), ("l_partkey", "dy"), ("l_quantity", "dw"), ("l_linenumber", "dh"))],
    ).dropDuplicates(["box_id"]).filter(F.col("score") > vision.SCORE)
    j = rows.join(F.broadcast(vision.priors(spark)), "ord")
    box = vision.decode({c: F.col(c) for c in ("cx", "cy", "w", "h")}, {c: F.col(c) for c in ("dx", "dy", "dw", "dh")}, F.lit(800.0), F.lit(600.0))
    boxes = j.select("page_id", "box_id", F.col("lord").alias("ord"), "score", F.struct(*[v.alias(k) for k, v in box.items()]).alias("bbox"))
    return regions.nms(boxes, ["page_id"], vision.OVERLAP)


def corpus_scores(spark: SparkSession, d: str) -> DataFrame:
    """Detection on the labelled corpus, by all rules and by content alone; the two visual cases need a model and are left out."""
    cases = corpus.corpus(spark).filter(F.col("category") != "visual")
    used = [x for x in detectors.DETECTORS if x.type != "sensitive"]
    parts = None
    for name, attributes in (("all rules", True), ("content rules", False)):
        found = detectors.detect(cases, ["case_id"], used, attributes).select("case_id").distinct().withColumn("hit", F.lit(True))
        rows = cases.select("case_id", F.col("expected_type").isNotNull().alias("actual")).join(found, "case_id", "left")
        one = evaluation.scores(evaluation.confusion(rows, F.col("actual"), F.col("hit"))).withColumn("rules", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def sql_scrub_elements(spark: SparkSession, d: str) -> DataFrame:
    """scrub_text by its SQL name."""
    sql.register(spark)
    rows = table(spark, d, "elements").select("page_id", "element_id", "text").distinct()
    return spark.sql("SELECT page_id, element_id, scrub_text(text) AS clean FROM {e} WHERE scrub_text(text) <> text", e=rows)


def sql_luhn_numbers(spark: SparkSession, d: str) -> DataFrame:
    """luhn_valid by its SQL name, over numbers made of order keys."""
    sql.register(spark)
    return spark.sql("SELECT o_orderkey, n AS number FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS STRING), 14, '7') || CAST(o_custkey % 10 AS STRING) AS n FROM {o}) WHERE luhn_valid(n)", o=table(spark, d, "orders"))


def sql_bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    """bbox_iou by its SQL name: each element's box against the visible part of its page."""
    sql.register(spark)
    e = table(spark, d, "elements").select("page_id", "element_id", "bbox").distinct()
    p = table(spark, d, "pages").select("page_id", "page_state").filter("page_state IS NOT NULL").dropDuplicates(["page_id"])
    box = "named_struct('x', p.page_state.scroll_x, 'y', p.page_state.scroll_y, 'width', double(p.page_state.viewport_width), 'height', double(p.page_state.viewport_height))"
    finite = "NOT isnan(bbox.x) AND NOT isnan(bbox.y) AND NOT isnan(bbox.width) AND NOT isnan(bbox.height)"
    return spark.sql(f"SELECT e.page_id, e.element_id, round(bbox_iou(e.bbox, {box}), 6) AS iou FROM {{e}} e JOIN {{p}} p ON e.page_id = p.page_id WHERE {finite}", e=e, p=p).filter("iou > 0")


def html_elements(spark: SparkSession, d: str) -> DataFrame:
    """The HTML tokenizer as a table function, over pages made of titles and addresses."""
    sql.register(spark)
    pages = table(spark, d, "pages").select("page_id", "title", "url").dropDuplicates(["page_id"]).filter("title IS NOT NULL")
    quoted = "replace(replace(title, '&', '&amp;'), '<', '&lt;')"
    return spark.sql(f"SELECT p.page_id, e.ord, e.parent_ord, e.tag, e.text, e.href FROM {{p}} p, LATERAL html_elements('<main><h1>' || {quoted} || '</h1><script>x</script><p>Go to <a href=\"' || p.url || '\">here</a></main>') e", p=pages)


QUERIES = {f.__name__: f for f in (metrics_report, scan_latency, unexpected_fields, region_ids, region_sources_merged, deep_scan, payload_bytes, history_lines, detector_output, corpus_scores, sql_scrub_elements, sql_luhn_numbers, sql_bbox_iou, html_elements)}

ORACLES = {
    "sql_scrub_elements": f"SELECT page_id, element_id, clean FROM (SELECT page_id, element_id, text, {S.scrub('text')} AS clean FROM {S.ELEMENTS}) WHERE clean <> text",
    "sql_luhn_numbers": f"SELECT o_orderkey, n AS number FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 14, '7') || CAST(o_custkey % 10 AS VARCHAR) AS n FROM orders) WHERE {S.luhn('n')}",
    "sql_bbox_iou": f"""WITH j AS (SELECT e.page_id, e.element_id, e.bbox.x AS x, e.bbox.y AS y, e.bbox.width AS w, e.bbox.height AS h, p.page_state.scroll_x AS px, p.page_state.scroll_y AS py, CAST(p.page_state.viewport_width AS DOUBLE) AS pw, CAST(p.page_state.viewport_height AS DOUBLE) AS ph
FROM {S.ELEMENTS} e JOIN {S.PAGES} p ON e.page_id = p.page_id WHERE p.page_state IS NOT NULL AND NOT isnan(e.bbox.x) AND NOT isnan(e.bbox.y) AND NOT isnan(e.bbox.width) AND NOT isnan(e.bbox.height)),
i AS (SELECT *, greatest(least(x + w, px + pw) - greatest(x, px), 0) * greatest(least(y + h, py + ph) - greatest(y, py), 0) AS i FROM j WHERE w * h > 0 AND pw * ph > 0)
SELECT page_id, element_id, iou FROM (SELECT page_id, element_id, round(i / (w * h + pw * ph - i), 6) AS iou FROM i WHERE i > 0) WHERE iou > 0""",
    "html_elements": f"""WITH p AS (SELECT page_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, url FROM {S.PAGES} WHERE title IS NOT NULL)
SELECT page_id, CAST(1 AS INTEGER) AS ord, CAST(NULL AS INTEGER) AS parent_ord, 'main' AS tag, NULL AS text, NULL AS href FROM p UNION ALL SELECT page_id, 2, 1, 'h1', nullif(title, ''), NULL FROM p
UNION ALL SELECT page_id, 3, 1, 'p', 'Go to', NULL FROM p UNION ALL SELECT page_id, 4, 3, 'a', 'here', url FROM p""",
    "metrics_report": f"""WITH r AS {S.REQUESTS} SELECT 'requests' AS metric, count(*) AS n FROM r UNION ALL SELECT 'unsanitised', count(*) FILTER (NOT (coalesce(privacy.sanitized, false) AND coalesce(privacy.raw_data_removed, false))) FROM r UNION ALL SELECT 'with_regions', count(*) FILTER (len(redactions) > 0) FROM r
UNION ALL SELECT 'regions_' || CASE WHEN x.type IN ('email', 'phone', 'password', 'face', 'id', 'sensitive') THEN x.type ELSE 'sensitive' END, count(*) FROM (SELECT unnest(redactions) AS x FROM r) WHERE x IS NOT NULL GROUP BY 1""",
    "scan_latency": f"""SELECT CASE WHEN coalesce(len(dom), 0) = 0 THEN '0' WHEN len(dom) <= 10 THEN '1-10' WHEN len(dom) <= 100 THEN '11-100' ELSE 'over 100' END AS elements, count(*) AS n, round(avg(privacy.scan_ms), 4) AS mean_ms, max(privacy.scan_ms) AS max_ms FROM {S.REQUESTS} WHERE privacy.scan_ms IS NOT NULL AND NOT isnan(privacy.scan_ms) GROUP BY 1""",
    "unexpected_fields": "SELECT count(*) AS n_payloads, count(*) FILTER (len(list_filter(json_keys(payload), lambda k: k NOT IN ('pageState', 'elements'))) > 0) AS n_unexpected FROM capture_records WHERE payload IS NOT NULL",
    "region_ids": f"SELECT x.source AS source, coalesce(len(list_filter(x.element_ids, lambda e: contains(x.region_id, e))) > 0, false) AS named, count(*) AS n FROM (SELECT unnest(redactions) AS x FROM {S.REQUESTS}) WHERE x IS NOT NULL GROUP BY 1, 2",
    "region_sources_merged": f"SELECT request_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(x.provenance.merged_from, []))))), '|'), '') AS merged_from, count(*) AS n FROM (SELECT request_id, unnest(redactions) AS x FROM {S.REQUESTS}) WHERE x IS NOT NULL GROUP BY request_id",
    "payload_bytes": "SELECT producer_id, count(*) AS n, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS bytes, CAST(max(octet_length(encode(payload))) AS INTEGER) AS largest FROM capture_records WHERE payload IS NOT NULL GROUP BY producer_id",
    "history_lines": f"""WITH h AS (SELECT request_id, array_to_string(list_transform(list_filter(step_history, lambda x: x IS NOT NULL), lambda x: 'Step ' || coalesce(CAST(x.step AS VARCHAR), '?') || ': ' || coalesce(x.action.action, '-') || CASE WHEN x.action.target IS NOT NULL THEN ' target=' || x.action.target ELSE '' END), chr(10)) AS history FROM {S.REQUESTS} WHERE len(step_history) > 0)
SELECT request_id, history, CAST(len(regexp_extract_all(history, 'Step')) AS INTEGER) AS n_steps FROM h""",
}
