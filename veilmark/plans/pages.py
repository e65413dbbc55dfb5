"""Queries over pages, elements, addresses and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions import text as X
from veilmark.functions import urls
from veilmark.operators import pages
from veilmark.plans import sqltext as S
from veilmark.sources import files, table


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return pages.deduplicated(table(spark, d, "elements"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").dropDuplicates(["page_id"])


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "agent_requests").dropDuplicates(["request_id"])


def page_counters(spark: SparkSession, d: str) -> DataFrame:
    return pages.counters(_elements(spark, d))


def highlight_index(spark: SparkSession, d: str) -> DataFrame:
    return pages.highlighted(_elements(spark, d)).select("page_id", "element_id", "new_index")


def tag_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return pages.tag_ordinals(_elements(spark, d)).select("page_id", "element_id", "tag", "tag_ordinal")


def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids for the elements whose id the page itself gave (no number of ours at its end): the others keep theirs."""
    e = _elements(spark, d).withColumn("own", F.when(F.col("element_id").rlike("[0-9]$"), F.col("element_id")))
    return pages.assigned_ids(e, "own").select("page_id", "element_id", "assigned_id")


def role_of_tag(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).withColumn("derived", pages.semantic_role())
    return e.groupBy("tag", "derived").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("derived").eqNullSafe(F.col("semantic_role"))).alias("n_same"))


def interactive_elements(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).filter(pages.is_interactive()).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("interactive").alias("n_flagged"))


def viewport_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each page that touch the visible rectangle of its state."""
    p = _pages(spark, d).filter(F.col("page_state").isNotNull()).select("page_id", "page_state")
    b = F.col("bbox")
    ok = b.isNotNull() & ~F.isnan(b["x"]) & ~F.isnan(b["y"]) & ~F.isnan(b["width"]) & ~F.isnan(b["height"])
    e = _elements(spark, d).filter(ok).select("page_id", "element_id", "bbox").join(p, "page_id")
    s = F.col("page_state")
    inside = pages.in_viewport(b, s["scroll_x"], s["scroll_y"], s["viewport_width"], s["viewport_height"])
    return e.filter(inside).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_visible"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of an element by the order of its sources, collapsed and capped."""
    t = X.collapse(F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("placeholder"), F.lit("")), F.nullif(F.trim("alt"), F.lit("")), F.lit("")))
    return _elements(spark, d).select("page_id", "element_id", X.cap(t, 40).alias("text"), (F.length(t) > 40).alias("capped"))


def labels_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Inputs with the label element just before them, where they have no label of their own."""
    w = Window.partitionBy("page_id").orderBy("ord", "element_id")
    e = _elements(spark, d).select("page_id", "element_id", "ord", "tag", "label", F.lag(F.when(F.col("tag") == "label", F.col("text"))).over(w).alias("before"))
    return e.filter(F.col("tag").isin("input", "textarea", "select")).select("page_id", "element_id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.nullif(F.trim("before"), F.lit(""))).alias("label"))


def links_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first of each (text, address) of a page, without empty, local and script addresses."""
    e = _elements(spark, d).filter(F.coalesce(F.trim("text"), F.lit("")) != "").filter(F.coalesce(F.trim("href"), F.lit("")) != "")
    e = e.filter(~F.col("href").startswith("#") & ~F.lower("href").startswith("javascript:"))
    return e.groupBy("page_id", "text", "href").agg(F.min("ord").alias("ord"))


def headings_first5(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("ord", "element_id")
    e = _elements(spark, d).filter(F.col("tag").isin("h1", "h2", "h3")).filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    e = e.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 5)
    return e.select("page_id", "rn", "tag", X.cap(X.collapse(F.col("text")), 200).alias("text"))


def control_top50(spark: SparkSession, d: str) -> DataFrame:
    return pages.prioritised(_elements(spark, d)).select("page_id", "element_id", "rank")


def semantic_tree_lines(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).filter(F.col("highlight_index").isNotNull())
    return e.select("page_id", "highlight_index", pages.tree_line().alias("line"))


def semantic_tree_digests(spark: SparkSession, d: str) -> DataFrame:
    t = pages.semantic_trees(_elements(spark, d), _pages(spark, d))
    return t.select("page_id", F.md5("tree").alias("digest"), F.length("tree").alias("n_chars"))


def page_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Pages by delay of delivery, per kind."""
    late = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("captured_at").cast("timestamp"))) / 1e6
    return _pages(spark, d).groupBy("page_kind", F.when(late < 60, "minute").when(late < 3600, "hour").otherwise("late").alias("delay")).agg(F.count(F.lit(1)).alias("n_pages"))


def site_top_pages(spark: SparkSession, d: str) -> DataFrame:
    """The three pages of each site with the most elements."""
    n = _elements(spark, d).groupBy("site", "page_id").agg(F.count(F.lit(1)).alias("n_elements"))
    w = Window.partitionBy("site").orderBy(F.desc("n_elements"), "page_id")
    return n.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 3).select("site", "page_id", "n_elements")


def duplicate_deliveries(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "elements").groupBy("page_id", "element_id").agg(F.count(F.lit(1)).alias("n"))
    return raw.groupBy("n").agg(F.count(F.lit(1)).alias("n_elements"))


SECRET_PARAMS = "?page=2&token=abc123&q=mail@site.example&ref=home#session_id=xyz9"


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = urls.split_url(F.col("url"))
    return _pages(spark, d).select("page_id", *[c.alias(n) for n, c in parts.items()])


def url_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses, with secrets added, sanitised."""
    u = F.concat("url", F.lit(SECRET_PARAMS))
    return _pages(spark, d).select("page_id", F.col("url"), u.alias("u"), urls.sanitize(u).alias("clean")).select("page_id", "clean", urls.is_sensitive(F.col("u")).alias("before"), urls.is_sensitive(F.col("clean")).alias("after"))


def url_params(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat("url", F.lit(SECRET_PARAMS))
    pairs = F.split(urls.split_url(u)["query"], "&")
    rows = _pages(spark, d).select(F.explode(pairs).alias("p")).select(F.substring_index("p", "=", 1).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("sensitive", urls.sensitive_key(F.col("key")))


def href_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).filter(urls.is_sensitive(F.col("href"))).select("page_id", "element_id", "href")


def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    r = _requests(spark, d).select(F.explode("redactions").alias("r")).filter(F.col("r").isNotNull())
    return r.groupBy(F.col("r.type").alias("type"), F.col("r.treatment").alias("treatment")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("r.element_ids") > 0).alias("n_referring"))


def step_last5(spark: SparkSession, d: str) -> DataFrame:
    """The last five steps of each request."""
    s = _requests(spark, d).select("request_id", F.posexplode("step_history").alias("i", "s")).filter(F.col("s").isNotNull())
    w = Window.partitionBy("request_id").orderBy(F.desc("i"))
    s = s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 5)
    return s.select("request_id", F.col("i").alias("pos"), F.col("s.action.action").alias("action"), F.col("s.action.target").alias("target"), F.col("s.result").alias("result"))


def action_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _requests(spark, d).select(F.explode("step_history").alias("s"))
    return s.groupBy(F.col("s.action.action").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count("s.action.target").alias("n_targets"), F.count_if(F.col("s.action.amount").between(0, 5000)).alias("n_amount_ok"))


def payload_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Elements, redactions and text bytes of a request, and whether the payload caps hold."""
    r = _requests(spark, d)
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    texts = F.aggregate(F.coalesce("dom", F.array().cast(r.schema["dom"].dataType)), F.lit(0), lambda a, e: a + F.coalesce(F.octet_length(e["text"]), F.lit(0)))
    return r.select("request_id", n("dom").alias("n_elements"), n("redactions").alias("n_redactions"), texts.alias("text_bytes"), ((n("dom") <= 2500) & (n("redactions") <= 1500)).alias("within_caps"))


def privacy_flags(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("privacy")
    whole = F.coalesce(p["sanitized"] & p["raw_data_removed"] & p["dom_sanitized"] & p["screenshot_sanitized"] & p["url_sanitized"], F.lit(False))
    return _requests(spark, d).groupBy(p.isNull().alias("missing"), whole.alias("complete")).agg(F.count(F.lit(1)).alias("n"), F.sum(p["regions_detected"]).alias("detected"), F.sum(p["regions_redacted"]).alias("redacted"))


def data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Text to a data address and back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    coded = files.data_url(F.encode("text", "UTF-8"), "text/plain")
    back = F.decode(files.from_data_url(coded), "UTF-8")
    return docs.select("doc_id", F.length(coded).alias("n_coded"), (back == F.col("text")).alias("same"))


def _cap(c: str) -> str:
    return f"CASE WHEN length({c}) > 80 THEN left({c}, 80) || '…' ELSE {c} END"


_LINE = f"""'[' || CAST(highlight_index AS VARCHAR) || '] <' || tag
|| CASE WHEN coalesce(input_type, '') <> '' AND input_type <> tag THEN ' type="' || input_type || '"' ELSE '' END
|| CASE WHEN coalesce(href, '') <> '' THEN ' href="' || {_cap('href')} || '"' ELSE '' END
|| CASE WHEN coalesce(placeholder, '') <> '' THEN ' placeholder="' || placeholder || '"' ELSE '' END
|| CASE WHEN checked IS NOT NULL THEN ' checked="' || CAST(checked AS VARCHAR) || '"' ELSE '' END
|| CASE WHEN coalesce(selected_value, '') <> '' THEN ' value="' || selected_value || '"' ELSE '' END
|| CASE WHEN coalesce(alt, '') <> '' THEN ' alt="' || alt || '"' ELSE '' END || '>'
|| CASE WHEN coalesce(text, '') <> '' THEN ' "' || {_cap('text')} || '"' ELSE '' END
|| CASE WHEN coalesce(label, '') <> '' AND label IS DISTINCT FROM text THEN ' label="' || label || '"' ELSE '' END
|| CASE WHEN coalesce(in_viewport, false) THEN '' ELSE ' [offscreen]' END"""


def _case(values: dict, column: str, default: str) -> str:
    return f"CASE lower({column}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


def _sensitive_key(k: str) -> str:
    return f"({k} IN ({', '.join(S.quote(w) for w in P.URL_PARAM)}) OR " + " OR ".join(f"contains({k}, {S.quote(w)})" for w in P.URL_PARAM_PART) + ")"


QUERIES = {f.__name__: f for f in (
    page_counters, highlight_index, tag_ordinals, assigned_ids, role_of_tag, interactive_elements, viewport_elements, clean_texts, labels_resolved, links_dedup, headings_first5, control_top50, semantic_tree_lines,
    semantic_tree_digests, page_freshness, site_top_pages, duplicate_deliveries, url_parts, url_sanitised, url_params, href_sensitive, redaction_counts, step_last5, action_counts, payload_sizes, privacy_flags, data_urls,
)}

E_ = S.ELEMENTS
ORACLES = {
    "page_counters": f"""SELECT page_id, count(*) AS n_elements, count(*) FILTER (lower(coalesce(tag, '')) = 'button' OR lower(coalesce(role, '')) = 'button' OR input_type = 'submit') AS n_buttons, count(*) FILTER (lower(tag) IN ('input', 'textarea')) AS n_inputs,
count(*) FILTER (lower(tag) = 'a') AS n_links, count(*) FILTER (lower(tag) = 'img') AS n_images, count(*) FILTER (lower(tag) IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')) AS n_headings, count(*) FILTER (interactive) AS n_interactive, count(*) FILTER (visible) AS n_visible, count(*) FILTER (in_viewport) AS n_in_viewport FROM {E_} GROUP BY page_id""",
    "highlight_index": f"SELECT page_id, element_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord, element_id) - 1 AS INTEGER) AS new_index FROM {E_}",
    "tag_ordinals": f"SELECT page_id, element_id, tag, CAST(row_number() OVER (PARTITION BY page_id, tag ORDER BY ord, element_id) AS INTEGER) AS tag_ordinal FROM {E_}",
    "assigned_ids": f"""WITH e AS (SELECT *, CASE WHEN regexp_matches(element_id, '[0-9]$') THEN trim(element_id) END AS own FROM {E_}),
n AS (SELECT *, max(TRY_CAST(nullif(regexp_extract(own, '^agent-[a-z]+-([0-9]{{1,9}})$', 1), '') AS INTEGER)) OVER (PARTITION BY page_id) AS top, count(*) FILTER (own IS NULL) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT page_id, element_id, coalesce(own, {_case(pages.PREFIX_OF_TAG, 'tag', 'agent-el')} || '-' || CAST(coalesce(top, -1) + run AS VARCHAR)) AS assigned_id FROM n""",
    "role_of_tag": f"SELECT tag, derived, count(*) AS n, count(*) FILTER (derived IS NOT DISTINCT FROM semantic_role) AS n_same FROM (SELECT tag, semantic_role, CASE WHEN trim(role) <> '' THEN role ELSE {_case(pages.ROLE_OF_TAG, 'tag', 'generic')} END AS derived FROM {E_}) GROUP BY tag, derived",
    "interactive_elements": f"SELECT tag, count(*) AS n, count(*) FILTER (interactive) AS n_flagged FROM {E_} WHERE coalesce(lower(tag) IN {pages.INTERACTIVE_TAGS}, false) OR coalesce(lower(role) IN {pages.INTERACTIVE_ROLES}, false) GROUP BY tag",
    "viewport_elements": f"""SELECT e.page_id, count(*) AS n_visible FROM {E_} e JOIN {S.PAGES} p ON e.page_id = p.page_id WHERE p.page_state IS NOT NULL AND e.bbox IS NOT NULL AND NOT isnan(e.bbox.x) AND NOT isnan(e.bbox.y) AND NOT isnan(e.bbox.width) AND NOT isnan(e.bbox.height)
AND e.bbox.x + e.bbox.width > p.page_state.scroll_x AND e.bbox.x < p.page_state.scroll_x + p.page_state.viewport_width AND e.bbox.y + e.bbox.height > p.page_state.scroll_y AND e.bbox.y < p.page_state.scroll_y + p.page_state.viewport_height GROUP BY e.page_id""",
    "clean_texts": f"SELECT page_id, element_id, CASE WHEN length(t) > 40 THEN left(t, 37) || '...' ELSE t END AS text, length(t) > 40 AS capped FROM (SELECT page_id, element_id, trim(regexp_replace(coalesce(nullif(trim(text), ''), nullif(trim(placeholder), ''), nullif(trim(alt), ''), ''), '\\s+', ' ', 'g')) AS t FROM {E_})",
    "labels_resolved": f"SELECT page_id, element_id, coalesce(nullif(trim(label), ''), nullif(trim(before), '')) AS label FROM (SELECT page_id, element_id, tag, label, lag(CASE WHEN tag = 'label' THEN text END) OVER (PARTITION BY page_id ORDER BY ord, element_id) AS before FROM {E_}) WHERE tag IN ('input', 'textarea', 'select')",
    "links_dedup": f"SELECT page_id, text, href, min(ord) AS ord FROM {E_} WHERE coalesce(trim(text), '') <> '' AND coalesce(trim(href), '') <> '' AND NOT starts_with(href, '#') AND NOT starts_with(lower(href), 'javascript:') GROUP BY page_id, text, href",
    "headings_first5": f"SELECT page_id, CAST(rn AS INTEGER) AS rn, tag, CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS text FROM (SELECT page_id, tag, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY page_id ORDER BY ord, element_id) AS rn FROM {E_} WHERE tag IN ('h1', 'h2', 'h3') AND coalesce(trim(text), '') <> '') WHERE rn <= 5",
    "control_top50": f"SELECT page_id, element_id, CAST(rank AS INTEGER) AS rank FROM (SELECT page_id, element_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN lower(tag) IN ('input', 'textarea', 'button', 'select') THEN 0 ELSE 1 END, ord, element_id) AS rank FROM {E_} WHERE interactive AND visible) WHERE rank <= 50",
    "semantic_tree_lines": f"SELECT page_id, highlight_index, {_LINE} AS line FROM {E_} WHERE highlight_index IS NOT NULL",
    "semantic_tree_digests": f"""WITH l AS (SELECT page_id, string_agg({_LINE}, chr(10) ORDER BY ord, element_id) AS lines FROM {E_} WHERE highlight_index IS NOT NULL GROUP BY page_id),
t AS (SELECT p.page_id, 'PAGE: ' || coalesce(p.page_state.url, '') || chr(10) || 'TITLE: ' || coalesce(p.page_state.title, '') || chr(10) || 'VIEWPORT: ' || coalesce(CAST(CAST(floor(p.page_state.scroll_y) AS BIGINT) AS VARCHAR), '') || '-' || coalesce(CAST(CAST(floor(p.page_state.scroll_y + p.page_state.viewport_height) AS BIGINT) AS VARCHAR), '') || ' of ' || coalesce(CAST(p.page_state.total_height AS VARCHAR), '') || 'px' || chr(10) || chr(10) || 'ELEMENTS:' || chr(10) || l.lines AS tree FROM {S.PAGES} p JOIN l ON p.page_id = l.page_id)
SELECT page_id, md5(tree) AS digest, CAST(length(tree) AS INTEGER) AS n_chars FROM t""",
    "page_freshness": f"SELECT page_kind, CASE WHEN epoch_us(received_at) - epoch_us(captured_at) < 60000000 THEN 'minute' WHEN epoch_us(received_at) - epoch_us(captured_at) < 3600000000 THEN 'hour' ELSE 'late' END AS delay, count(*) AS n_pages FROM {S.PAGES} GROUP BY 1, 2",
    "site_top_pages": f"SELECT site, page_id, n_elements FROM (SELECT site, page_id, count(*) AS n_elements, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, page_id) AS rn FROM {E_} GROUP BY site, page_id) WHERE rn <= 3",
    "duplicate_deliveries": "SELECT n, count(*) AS n_elements FROM (SELECT count(*) AS n FROM elements GROUP BY page_id, element_id) GROUP BY n",
    "url_parts": f"""SELECT page_id, regexp_extract(url, '^(https?://)', 1) || regexp_extract(url, '^https?://([^/?#@]*)', 1) AS prefix, '' AS userinfo, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM {S.PAGES}""",
    "url_sanitised": f"SELECT page_id, url || '?page=2&ref=home&token=[REDACTED]&q=[REDACTED]#session_id=[REDACTED]' AS clean, true AS before, false AS after FROM {S.PAGES}",
    "url_params": f"SELECT key, n, {_sensitive_key('key')} AS sensitive FROM (SELECT key, count(*) AS n FROM (SELECT split_part(unnest(string_split(regexp_extract(url || '{SECRET_PARAMS}', '\\?([^#]*)', 1), '&')), '=', 1) AS key FROM {S.PAGES}) GROUP BY key)",
    "redaction_counts": f"SELECT r.type AS type, r.treatment AS treatment, count(*) AS n, count(*) FILTER (len(r.element_ids) > 0) AS n_referring FROM (SELECT unnest(redactions) AS r FROM {S.REQUESTS}) WHERE r IS NOT NULL GROUP BY 1, 2",
    "step_last5": f"SELECT request_id, CAST(i AS INTEGER) AS pos, s.action.action AS action, s.action.target AS target, s.result AS result FROM (SELECT request_id, unnest(range(len(step_history))) AS i, unnest(step_history) AS s FROM {S.REQUESTS}) WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY i DESC) <= 5",
    "action_counts": f"SELECT s.action.action AS action, count(*) AS n, count(s.action.target) AS n_targets, count(*) FILTER (s.action.amount BETWEEN 0 AND 5000) AS n_amount_ok FROM (SELECT unnest(step_history) AS s FROM {S.REQUESTS}) GROUP BY 1",
    "payload_sizes": f"SELECT request_id, CAST(coalesce(len(dom), 0) AS INTEGER) AS n_elements, CAST(coalesce(len(redactions), 0) AS INTEGER) AS n_redactions, CAST(coalesce(list_sum(list_transform(dom, lambda e: coalesce(octet_length(encode(e.text)), 0))), 0) AS INTEGER) AS text_bytes, coalesce(len(dom), 0) <= 2500 AND coalesce(len(redactions), 0) <= 1500 AS within_caps FROM {S.REQUESTS}",
    "privacy_flags": f"SELECT privacy IS NULL AS missing, coalesce(privacy.sanitized AND privacy.raw_data_removed AND privacy.dom_sanitized AND privacy.screenshot_sanitized AND privacy.url_sanitized, false) AS complete, count(*) AS n, CAST(sum(privacy.regions_detected) AS BIGINT) AS detected, CAST(sum(privacy.regions_redacted) AS BIGINT) AS redacted FROM {S.REQUESTS} GROUP BY 1, 2",
    "data_urls": "SELECT doc_id, CAST(length('data:text/plain;base64,' || base64(encode(text))) AS INTEGER) AS n_coded, true AS same FROM documents",
}
