"""Queries of detection, scrubbing and the gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions import text as X
from veilmark.operators import detectors, evaluation, pages, sanitising, telemetry
from veilmark.plans import sqltext as S
from veilmark.sources import table

KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[str], str]]] = {
    "email": (lambda c: X.matches(c, P.EMAIL), lambda c: S.match(c, P.EMAIL)),
    "phone": (lambda c: X.matches(c, P.PHONE), lambda c: S.match(c, P.PHONE)),
    "id": (lambda c: X.matches(c, P.NATIONAL_ID_DETECT), lambda c: S.match(c, P.NATIONAL_ID_DETECT)),
    "api_key": (lambda c: X.matches(c, P.API_KEY_ANY), lambda c: S.match(c, P.API_KEY_ANY)),
    "credit_card": (X.has_card, S.card),
    "secret": (lambda c: X.matches(c, P.SECRET), lambda c: S.match(c, P.SECRET)),
}


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return pages.deduplicated(table(spark, d, "elements"))


def _detect_documents(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "documents").select("doc_id", "text").filter(KINDS[kind][0](F.col("text"))).select("doc_id")

    return query


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, lang, type): one row a document and kind."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    kinds = F.array_compact(F.array(*[F.when(find(F.col("text")), F.lit(k)) for k, (find, _) in KINDS.items()]))
    return docs.select("doc_id", "source", "lang", F.explode(kinds).alias("type"))


HITS_SQL = "WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, source, lang, '{k}' AS type FROM documents WHERE {sql('text')}" for k, (_, sql) in KINDS.items()) + ")"


def exposure_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Per source and language: documents, documents the gate blocks as they are, and after scrubbing."""
    docs = table(spark, d, "documents").select("source", "lang", "text")
    docs = docs.withColumn("clean", X.scrub(F.col("text")))
    return docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.size(_gate(F.col("text"))) > 0).alias("n_blocked"), F.count_if(F.size(_gate(F.col("clean"))) > 0).alias("n_blocked_after")
    )


GATE_RULES = (P.EMAIL, P.PHONE, P.NATIONAL_ID, P.API_KEY, P.CARD_LOOSE, P.PRIVATE_KEY)


def _gate(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(X.matches(c, p), F.lit(i)) for i, p in enumerate(GATE_RULES)]))


def _gate_sql(c: str) -> str:
    return "(" + " OR ".join(S.match(c, p) for p in GATE_RULES) + ")"


def detect_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", "type")


def detect_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n_docs"))


def detect_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).rollup("source", "type").agg(F.count(F.lit(1)).alias("n_docs"))


def detect_cube(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).cube("lang", "type").agg(F.count(F.lit(1)).alias("n_docs"), F.grouping_id().alias("level"))


def detect_regions(spark: SparkSession, d: str) -> DataFrame:
    """All detectors over the elements."""
    return detectors.detect(_elements(spark, d)).select("page_id", "element_id", "region_id", "type", "confidence", "source", "redaction", "detector_ord")


def detect_content_only(spark: SparkSession, d: str) -> DataFrame:
    return detectors.detect(_elements(spark, d), attributes=False).select("page_id", "element_id", "type", "confidence")


def region_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.type_counts(detectors.detect(_elements(spark, d)))


def page_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Regions and redacted elements of each page, with the highest confidence."""
    r = detectors.detect(_elements(spark, d))
    return r.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_regions"), F.count_distinct("element_id").alias("n_elements"), F.max("confidence").alias("max_confidence"))


def confusion_attribute_content(spark: SparkSession, d: str) -> DataFrame:
    """Content rules held against attribute rules as labels, by type."""
    e = _elements(spark, d)
    both = {x.type: x for x in detectors.DETECTORS if x.content is not None and x.type in ("email", "phone", "id", "api_key", "credit_card")}
    flags = []
    for kind, x in both.items():
        content = F.lit(False)
        for f in x.fields:
            content = content | F.when(F.length(F.trim(F.col(f))) >= x.least_length, x.content(F.col(f))).otherwise(F.lit(False))
        flags.append(F.struct(F.lit(kind).alias("type"), x.attribute().alias("actual"), content.alias("predicted")))
    rows = e.select(F.explode(F.array(*flags)).alias("f")).select("f.*")
    return evaluation.scores(evaluation.confusion(rows, F.col("actual"), F.col("predicted"), ["type"]))


def scrub_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that scrubbing changes, with the digest and length of the result."""
    docs = table(spark, d, "documents").select("doc_id", "text", X.scrub(F.col("text")).alias("clean")).filter(F.col("clean") != F.col("text"))
    return docs.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("n_chars"))


def scrub_elements(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).select("page_id", "element_id", "text", X.scrub(F.col("text")).alias("clean"))
    return e.filter(F.col("clean") != F.col("text")).select("page_id", "element_id", "clean")


def scrub_idempotent(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(X.scrub(F.col("text")).alias("once"))
    return docs.select(F.col("once"), X.scrub(F.col("once")).alias("twice")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("once") != F.col("twice")).alias("n_changed_again"))


def luhn_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Digit runs of 13 to 19 in the elements, with their checksum."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9][0-9 -]{11,22}[0-9])"), F.lit(1))
    e = _elements(spark, d).select("page_id", "element_id", F.explode(F.array_distinct(found)).alias("number"))
    e = e.filter(F.length(X.digits(F.col("number"))).between(13, 19))
    return e.select("page_id", "element_id", "number", X.luhn(F.col("number")).alias("valid"), X.luhn(F.col("number"), False).alias("valid_loose"))


def luhn_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The checksum over numbers made of order keys: valid ones are one in ten."""
    n = F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 14, "7"), (F.col("o_custkey") % 10).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", n.alias("number")).filter(X.luhn(F.col("number")))


def gate_field_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = sanitising.element_codes(_elements(spark, d))
    return rows.select("page_id", "element_id", "field", F.array_join("codes", "|").alias("codes"))


def gate_pages(spark: SparkSession, d: str) -> DataFrame:
    return sanitising.page_verdicts(_elements(spark, d))


def gate_after_sanitising(spark: SparkSession, d: str) -> DataFrame:
    """Pages still unsafe after detection and sanitising, by first code."""
    e = _elements(spark, d)
    clean = sanitising.sanitise(e, flag=detectors.flagged())
    return sanitising.page_verdicts(clean).groupBy("safe", "first_code").agg(F.count(F.lit(1)).alias("n_pages"))


def sanitised_treatments(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    clean = sanitising.sanitise(e, flag=detectors.flagged())
    return clean.groupBy("treatment").agg(F.count(F.lit(1)).alias("n_elements"), F.count_if(F.col("text") == P.REDACTED).alias("n_redacted_texts"), F.count_if(F.col("placeholder") == P.REDACTED).alias("n_redacted_placeholders"))


def _request_codes(spark: SparkSession, d: str) -> DataFrame:
    return sanitising.request_codes(table(spark, d, "agent_requests").dropDuplicates(["request_id"]))


def gate_first_code(spark: SparkSession, d: str) -> DataFrame:
    """The gate's verdict on each request: the first rule it breaks."""
    return _request_codes(spark, d).select("request_id", F.get("codes", 0).alias("first_code"), F.size("codes").alias("n_codes"))


def gate_all_codes(spark: SparkSession, d: str) -> DataFrame:
    """Requests and breaches by rule."""
    rows = _request_codes(spark, d).select("request_id", F.explode("codes").alias("code")).groupBy("request_id", "code").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n").alias("n_breaches"))


def server_verdicts(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "agent_requests").dropDuplicates(["request_id"])
    return sanitising.request_verdicts(requests)


def server_reasons(spark: SparkSession, d: str) -> DataFrame:
    return server_verdicts(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n_requests"))


def pattern_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each kind and their summed length over all documents."""
    rules = {"email": P.EMAIL, "phone": P.PHONE, "national_id": P.NATIONAL_ID, "card": P.CARD_SPACED}
    docs = table(spark, d, "documents").select("text")
    found = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(f"({P.java(p)})"), F.lit(1)).alias("m")) for k, p in rules.items()]
    rows = docs.select(F.explode(F.array(*found)).alias("x")).select("x.kind", F.explode("x.m").alias("m"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("m").alias("n_distinct"), F.sum(F.length("m")).alias("n_chars"))


def _attribute_sql(x: str) -> str:
    one = lambda c, *v: f"coalesce({c} IN ({', '.join(S.quote(w) for w in v)}), false)"
    meta = "lower(concat_ws(' ', coalesce(element_id, ''), coalesce(label, ''), coalesce(placeholder, ''), coalesce(autocomplete, '')))"
    return {
        "password": f"{one('input_type', 'password')} OR {S.any_of('autocomplete', ('password',))} OR {S.any_of('element_id', P.PASSWORD_ID)} OR {S.any_of('label', P.PASSWORD_LABEL)} OR {S.any_of('placeholder', P.PASSWORD_LABEL)}",
        "email": f"{one('input_type', 'email')} OR {one('autocomplete', 'email')} OR {S.any_of('element_id', ('email',))} OR {S.any_of('label', ('email',))} OR {S.any_of('placeholder', ('email',))}",
        "phone": f"{one('input_type', 'tel')} OR {one('autocomplete', 'tel')} OR {S.any_of('element_id', ('phone',))} OR {S.any_of('label', ('phone',))} OR {S.any_of('placeholder', ('phone',))}",
        "id": f"{S.any_of('label', P.ID_LABEL)} OR {S.any_of('element_id', P.ID_ID)}",
        "sensitive": f"{S.any_of('label', P.SEMANTIC)} OR {S.any_of('element_id', P.SEMANTIC)} OR {S.any_of('placeholder', P.SEMANTIC)} OR ({one('input_type', 'text')} AND ({S.any_of('label', ('name',))} OR {S.any_of('element_id', ('name',))} OR {S.any_of('placeholder', ('name',))}))",
        "api_key": S.any_of(meta, P.API_KEY_FIELD),
        "credit_card": f"{S.any_of(meta, P.CARD_FIELD)} OR coalesce(lower(autocomplete) IN ('cc-number', 'cc-csc', 'cc-exp'), false)",
        "secret": "false",
    }[x]


def _content_sql(d: detectors.Detector) -> str:
    if d.content is None:
        return "false"
    return "(" + " OR ".join(f"(length(trim(coalesce({f}, ''))) >= {d.least_length} AND {KINDS[d.type][1](f)})" for f in d.fields) + ")"


def _detect_sql(attributes: bool = True) -> str:
    parts = []
    for i, x in enumerate(detectors.DETECTORS):
        a = _attribute_sql(x.type) if attributes else "false"
        parts.append(
            f"SELECT page_id, element_id, '{x.prefix}_' || element_id AS region_id, '{x.type}' AS type, CAST(CASE WHEN {a} THEN {x.attribute_confidence} ELSE {x.content_confidence} END AS DOUBLE) AS confidence, "
            f"CASE WHEN {a} THEN 'dom' ELSE 'regex' END AS source, '{x.redaction}' AS redaction, CAST({i} AS INTEGER) AS detector_ord FROM e WHERE ({a}) OR {_content_sql(x)}"
        )
    return f"WITH e AS {S.ELEMENTS}, r AS (" + " UNION ALL ".join(parts) + ")"


def _confusion_sql() -> str:
    parts = [f"SELECT '{x.type}' AS type, ({_attribute_sql(x.type)}) AS a, {_content_sql(x)} AS p FROM e" for x in detectors.DETECTORS if x.content is not None and x.type != "secret"]
    return f"""WITH e AS {S.ELEMENTS}, r AS ({' UNION ALL '.join(parts)}),
c AS (SELECT type, count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM r GROUP BY type),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT type, tp, fp, fn, tn, round(p * 100, 2) AS precision, round(r * 100, 2) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END * 100, 2) AS f1 FROM s"""


def _server_sql() -> str:
    def rule(v: str) -> str:
        cases = " ".join(f"WHEN {S.match(v, p)} THEN '{name}'" for name, p in sanitising.SERVER_RULES)
        return f"CASE WHEN coalesce(trim({v}), '') IN ('', '[REDACTED]') THEN NULL {cases} END"

    per = [f"({rule(f'trim(x.{f})')}) || ' in element ({f})'" for f in ("text", "label", "placeholder")]
    element = f"coalesce({', '.join(per)}, CASE WHEN x.input_type = 'password' AND coalesce(trim(x.text), '') NOT IN ('', '[REDACTED]') THEN 'Password value in element' END)"
    return f"""WITH q AS {S.REQUESTS},
el AS (SELECT request_id, unnest(dom) AS x, unnest(range(len(dom))) AS i FROM q),
er AS (SELECT request_id, i, {element} AS r FROM el),
f AS (SELECT request_id, min_by(r, i) AS r FROM er WHERE r IS NOT NULL GROUP BY request_id)
SELECT q.request_id, CASE WHEN coalesce(len(dom), 0) > 2500 THEN 'Too many elements' WHEN coalesce(len(redactions), 0) > 1500 THEN 'Too many redactions'
WHEN NOT coalesce(privacy.sanitized, false) OR NOT coalesce(privacy.raw_data_removed, false) THEN 'Not sanitized'
WHEN {S.match('page_url', P.SERVER_URL_PARAM)} THEN 'Sensitive URL parameters in page_url'
WHEN ({rule("coalesce(semantic_tree, '')")}) IS NOT NULL THEN ({rule("coalesce(semantic_tree, '')")}) || ' in semantic_tree'
WHEN {S.match("semantic_tree", P.SERVER_URL_PARAM)} THEN 'Sensitive URL parameters in semantic_tree' ELSE f.r END AS reason
FROM q LEFT JOIN f ON q.request_id = f.request_id"""


GATE_CODES = (("LEAKED_EMAIL", P.EMAIL), ("LEAKED_PHONE", P.PHONE), ("LEAKED_NATIONAL_ID", P.NATIONAL_ID), ("LEAKED_API_KEY", P.API_KEY), ("LEAKED_CREDIT_CARD", P.CARD_LOOSE), ("LEAKED_PRIVATE_KEY", P.PRIVATE_KEY))


def _codes_sql() -> str:
    """The gate's codes by field; addresses are left to the expression, as no address of the tables is sensitive."""
    password = f"(coalesce(input_type = 'password', false) OR {S.any_of('autocomplete', ('password',))} OR {S.any_of('element_id', (*P.PASSWORD_NAME, 'pin'))})"
    parts = []
    for i, f in enumerate(("text", "placeholder", "label", "alt", "selected_value", "href", "src")):
        rules = [f"CASE WHEN {password} THEN 'LEAKED_PASSWORD' END"]
        for code, p in GATE_CODES:
            hit = S.match(f"trim({f})", p)
            rules.append(f"CASE WHEN {hit}{' OR ' + S.luhn(f'trim({f})', False) if code == 'LEAKED_CREDIT_CARD' else ''} THEN '{code}' END")
        parts.append(f"SELECT page_id, element_id, ord, {i} AS field_ord, '{f}' AS field, list_filter([{', '.join(rules)}], lambda c: c IS NOT NULL) AS codes FROM e WHERE trim({f}) <> '' AND trim({f}) <> '[REDACTED]'")
    return f"WITH e AS {S.ELEMENTS}, c AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE len(codes) > 0)"


def _request_codes_sql() -> str:
    """The gate over requests: (request_id, ord, code), ord in the order of the rules. Addresses: parameters of a telling name, as the tables have no others."""
    password = f"(coalesce(x.input_type = 'password', false) OR {S.any_of('x.element_id', (*P.PASSWORD_NAME, 'pin'))})"
    url = lambda c: f"coalesce(regexp_matches({c}, '[?&](token|access_token|auth|key|api_key|secret|password|pwd|session_id|sid|code|jwt|session)=[^&\\s]'), false)"
    flat = [
        ("privacy IS NULL", "MISSING_PRIVACY_METADATA"), ("NOT coalesce(privacy.raw_data_removed, true) OR NOT coalesce(privacy.sanitized, true)", "INCOMPLETE_SANITIZATION"),
        ("NOT coalesce(privacy.dom_sanitized, true) OR NOT coalesce(privacy.screenshot_sanitized, true) OR NOT coalesce(privacy.url_sanitized, true)", "STAGE_VERIFICATION_FAILED"),
        (url("page_url"), "SENSITIVE_URL_PARAM"), (url("page_state.url"), "SENSITIVE_URL_PARAM"),
    ]
    parts = [f"SELECT request_id, {i} AS ord, '{code}' AS code FROM q WHERE {hit}" for i, (hit, code) in enumerate(flat)]
    for j, f in enumerate(("text", "placeholder", "label")):
        live = f"trim(x.{f}) <> '' AND trim(x.{f}) <> '[REDACTED]'"
        for k, (code, p) in enumerate((("LEAKED_PASSWORD", None), *GATE_CODES)):
            hit = password if p is None else S.match(f"trim(x.{f})", p) + (f" OR {S.luhn(f'trim(x.{f})', False)}" if code == "LEAKED_CREDIT_CARD" else "")
            parts.append(f"SELECT request_id, 1000 + i * 100 + {j * 20 + k}, '{code}' FROM el WHERE x IS NOT NULL AND {live} AND ({hit})")
    for k, (code, p) in enumerate(GATE_CODES):
        name = ("LEAKED_ID" if code == "LEAKED_NATIONAL_ID" else code) + "_SEMANTIC"
        parts.append(f"SELECT request_id, 100000000 + {k}, '{name}' FROM q WHERE trim(semantic_tree) <> '[REDACTED]' AND {S.match('trim(semantic_tree)', p)}")
    parts.append(f"SELECT request_id, 100000010, 'SENSITIVE_URL_SEMANTIC' FROM q WHERE {S.match('semantic_tree', P.SERVER_URL_PARAM)}")
    parts.append("SELECT request_id, 200000000 + i * 2, 'INVALID_REDACTION_TREATMENT' FROM rd WHERE x IS NOT NULL AND coalesce(x.treatment, '') NOT IN ('blackout', 'mask', 'blur')")
    parts.append("SELECT request_id, 200000001 + i * 2, 'INVALID_REDACTION_BBOX' FROM rd WHERE x IS NOT NULL AND (x.bbox IS NULL OR coalesce(x.bbox.width, 0) <= 0 OR coalesce(x.bbox.height, 0) <= 0)")
    return f"""WITH q AS {S.REQUESTS}, el AS (SELECT request_id, unnest(dom) AS x, unnest(range(len(dom))) AS i FROM q), rd AS (SELECT request_id, unnest(redactions) AS x, unnest(range(len(redactions))) AS i FROM q),
c AS ({' UNION ALL '.join(parts)})"""


def _treatments_sql() -> str:
    password = f"(coalesce(input_type = 'password', false) OR {S.any_of('autocomplete', ('password',))} OR {S.any_of('e.element_id', (*P.PASSWORD_NAME, 'pin'))})"
    return _detect_sql() + f""", f AS (SELECT DISTINCT page_id, element_id, true AS hit FROM r),
t AS (SELECT e.text, e.placeholder, CASE WHEN {password} THEN 'password' WHEN f.hit THEN 'region' ELSE 'scrub' END AS treatment FROM e LEFT JOIN f ON e.page_id = f.page_id AND e.element_id = f.element_id)
SELECT treatment, count(*) AS n_elements,
count(*) FILTER (CASE treatment WHEN 'password' THEN true WHEN 'region' THEN coalesce(text, '') <> '' ELSE coalesce({S.scrub('text')} = '[REDACTED]', false) END) AS n_redacted_texts,
count(*) FILTER (CASE WHEN treatment = 'scrub' THEN coalesce({S.scrub('placeholder')} = '[REDACTED]', false) ELSE coalesce(placeholder, '') <> '' END) AS n_redacted_placeholders FROM t GROUP BY treatment"""


INVENTORY_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) AS n, count(DISTINCT m) AS n_distinct, sum(length(m)) AS n_chars FROM (SELECT unnest(regexp_extract_all(text, {S.quote(p)})) AS m FROM documents) HAVING count(*) > 0"
    for k, p in {"email": P.EMAIL, "phone": P.PHONE, "national_id": P.NATIONAL_ID, "card": P.CARD_SPACED}.items()
)

QUERIES = {
    "exposure_by_source": exposure_by_source,
    **{f"detect_{k}_documents": _detect_documents(k) for k in KINDS},
    **{f.__name__: f for f in (
        detect_hits, detect_counts_by_source, detect_rollup, detect_cube, detect_regions, detect_content_only, region_type_counts, page_exposure, confusion_attribute_content, scrub_documents, scrub_elements,
        scrub_idempotent, luhn_candidates, luhn_numbers, gate_field_codes, gate_pages, gate_first_code, gate_all_codes, gate_after_sanitising, sanitised_treatments, server_verdicts, server_reasons, pattern_inventory,
    )},
}

ORACLES = {
    "exposure_by_source": f"SELECT source, lang, count(*) AS n_docs, count(*) FILTER ({_gate_sql('text')}) AS n_blocked, count(*) FILTER ({_gate_sql('clean')}) AS n_blocked_after FROM (SELECT *, {S.scrub('text')} AS clean FROM documents) GROUP BY source, lang",
    **{f"detect_{k}_documents": f"SELECT doc_id FROM documents WHERE {sql('text')}" for k, (_, sql) in KINDS.items()},
    "detect_hits": HITS_SQL + " SELECT doc_id, type FROM h",
    "detect_counts_by_source": HITS_SQL + " SELECT source, type, count(*) AS n_docs FROM h GROUP BY source, type",
    "detect_rollup": HITS_SQL + " SELECT source, type, count(*) AS n_docs FROM h GROUP BY ROLLUP (source, type) HAVING count(*) > 0",
    "detect_cube": HITS_SQL + " SELECT lang, type, count(*) AS n_docs, CAST(grouping(lang, type) AS BIGINT) AS level FROM h GROUP BY CUBE (lang, type) HAVING count(*) > 0",
    "detect_regions": _detect_sql() + " SELECT * FROM r",
    "detect_content_only": _detect_sql(False) + " SELECT page_id, element_id, type, confidence FROM r",
    "region_type_counts": _detect_sql() + " SELECT CASE WHEN type IN ('email', 'phone', 'password', 'face', 'id', 'sensitive') THEN type ELSE 'sensitive' END AS type, count(*) AS n FROM r GROUP BY 1",
    "page_exposure": _detect_sql() + " SELECT page_id, count(*) AS n_regions, count(DISTINCT element_id) AS n_elements, max(confidence) AS max_confidence FROM r GROUP BY page_id",
    "confusion_attribute_content": _confusion_sql(),
    "scrub_documents": f"SELECT doc_id, md5(clean) AS digest, CAST(length(clean) AS INTEGER) AS n_chars FROM (SELECT doc_id, text, {S.scrub('text')} AS clean FROM documents) WHERE clean <> text",
    "scrub_elements": f"SELECT page_id, element_id, clean FROM (SELECT page_id, element_id, text, {S.scrub('text')} AS clean FROM {S.ELEMENTS}) WHERE clean <> text",
    "scrub_idempotent": f"SELECT count(*) AS n_docs, count(*) FILTER ({S.scrub('clean')} <> clean) AS n_changed_again FROM (SELECT {S.scrub('text')} AS clean FROM documents)",
    "luhn_candidates": f"""SELECT page_id, element_id, n AS number, {S.luhn('n')} AS valid, {S.luhn('n', False)} AS valid_loose FROM (
SELECT page_id, element_id, unnest(list_distinct(regexp_extract_all(text, '[0-9][0-9 -]{{11,22}}[0-9]'))) AS n FROM {S.ELEMENTS}) WHERE length(regexp_replace(n, '[^0-9]', '', 'g')) BETWEEN 13 AND 19""",
    "luhn_numbers": f"SELECT o_orderkey, n AS number FROM (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 14, '7') || CAST(o_custkey % 10 AS VARCHAR) AS n FROM orders) WHERE {S.luhn('n')}",
    "gate_field_codes": _codes_sql() + " SELECT page_id, element_id, field, array_to_string(codes, '|') AS codes FROM c",
    "gate_pages": _codes_sql() + """, f AS (SELECT page_id, min_by(codes[1], ord * 100 + field_ord) AS first_code, CAST(sum(len(codes)) AS BIGINT) AS n_violations FROM c GROUP BY page_id)
SELECT e.page_id, count(*) AS n_elements, coalesce(any_value(f.n_violations), 0) AS n_violations, any_value(f.first_code) AS first_code, any_value(f.first_code) IS NULL AS safe FROM e LEFT JOIN f ON e.page_id = f.page_id GROUP BY e.page_id""",
    "gate_first_code": _request_codes_sql() + " SELECT q.request_id, min_by(c.code, c.ord) AS first_code, CAST(count(c.code) AS INTEGER) AS n_codes FROM q LEFT JOIN c ON q.request_id = c.request_id GROUP BY q.request_id",
    "gate_all_codes": _request_codes_sql() + " SELECT code, count(DISTINCT request_id) AS n_requests, count(*) AS n_breaches FROM c GROUP BY code",
    "sanitised_treatments": _treatments_sql(),
    "server_verdicts": _server_sql(),
    "server_reasons": f"SELECT reason, count(*) AS n_requests FROM ({_server_sql()}) GROUP BY reason",
    "pattern_inventory": INVENTORY_SQL,
}
