"""Shared inlining and schema lifespans."""

import json

from pyspark.sql import functions as F

from veilmark.operators import drift, shredding

SCHEMA = (
    "id string, box struct<x:int,y:int>, box_x string, kids array<struct<name:string,box:struct<x:int,y:int>,tags:array<string>,more:map<string,int>,kids:array<struct<name:string,tags:array<string>>>>>, "
    "refs array<struct<to:string,many:array<string>>>, extra string"
)
ROWS = [
    ("a", (1, 2), "clash", [("k0", (3, 4), ["t0", None], {"m": 1}, [("deep", ["d"])]), None, ("k2", None, [], None, None)], [("k2", ["k0", "zz", None]), (None, None), None], "e"),
    ("b", None, None, None, [], None),
    (None, None, None, [], None, None),
]


def tables(spark, **kw):
    return shredding.shred(spark.createDataFrame(ROWS, SCHEMA), "root", "id", **kw)


def test_tables_and_kinds(spark):
    kinds = {n["table_name"]: n["kind"] for n in shredding.schema_graph(spark.createDataFrame(ROWS, SCHEMA), "root", "id")}
    assert kinds == {"root": "root", "box": "shared", "kids": "repeated", "kids__tags": "repeated", "kids__more": "repeated", "refs": "repeated", "refs__many": "repeated"}


def test_no_child_is_lost(spark):
    t = tables(spark)
    assert t["root"].count() == 3
    kids = {r["row_id"]: r for r in t["kids"].collect()}
    assert set(kids) == {"kids/0", "kids/1", "kids/2", "kids/0/kids/0"}
    assert kids["kids/1"]["entry_null"] is True and kids["kids/0"]["entry_null"] is False
    assert kids["kids/0/kids/0"]["parent_id"] == "kids/0" and kids["kids/0/kids/0"]["name"] == "deep"
    assert {(r["parent_id"], r["value"]) for r in t["kids__tags"].collect()} == {("kids/0", "t0"), ("kids/0", None), ("kids/0/kids/0", "d")}
    assert {(r["parent_table"], r["x"]) for r in t["box"].collect()} == {("root", 1), ("kids", 3)}


def test_references(spark):
    t = tables(spark, references={"refs.to": "kids.name", "refs.many": "kids.name"})
    assert {(r["refs_ord"], r["to"], r["to_kids_ref_ord"]) for r in t["refs"].collect()} == {(0, "k2", 2), (1, None, -1), (2, None, -1)}
    assert {(r["value"], r["kids_ref_ord"]) for r in t["refs__many"].collect()} == {("k0", 0), ("zz", -1), (None, -1)}


def test_clashing_names_get_a_suffix(spark):
    flat = shredding.shred(spark.createDataFrame([("a", (1,), "c")], "id string, box struct<x:int>, box_x string"), "root", "id", share=False)["root"]
    assert flat.columns == ["id", "box_x", "box_x_2"]


def test_identical_deliveries(spark):
    twice = spark.createDataFrame(ROWS[:1] * 2, SCHEMA)
    t = shredding.shred(twice, "root", "id", dedupe=True)
    assert t["root"].count() == 1 and t["kids"].count() == 4


def test_empty_table(spark):
    t = shredding.shred(spark.createDataFrame([], SCHEMA), "root", "id")
    assert all(x.count() == 0 for x in t.values()) and "row_id" in t["kids"].columns


def record(state, elements=({},)):
    return json.dumps({"pageState": state, "elements": list(elements)})


def files(spark, *payloads):
    """One producer; each argument is the list of payloads of a file."""
    return spark.createDataFrame([("p", 10 * i, p) for i, f in enumerate(payloads) for p in f], "producer_id string, file_seq int, payload string")


def found(spark, *payloads):
    return {(r["file_seq"], r["field"], r["change"]) for r in drift.changes(files(spark, *payloads)).collect()}


def test_changes(spark):
    got = found(
        spark,
        [record({"scroll_y": 1}), record({"scroll_y": None}), None, "no json"],
        [record({"scroll_y": 1.5})],
        [record({"scroll_position": {"y": "3px"}})],
        [record({})],
        [record({"scrollTop": 2})],
        [record({"scrollTop": 2}, [{"id": 5, "type": ["tel"]}])],
        [record({"scrollTop": 2}, [{"id": "5", "type": "tel"}, {"id": None}])],
    )
    assert got == {
        (20, "scroll_y", "renamed"), (20, "scroll_y", "retyped"), (30, "scroll_y", "removed"), (40, "scroll_y", "added"), (50, "element_id", "added"), (50, "input_type", "added"), (60, "element_id", "retyped"), (60, "input_type", "retyped"),
    }


def test_no_change_without_a_file_before(spark):
    assert found(spark, [record({"scroll_y": 1})]) == set()
    assert drift.changes(files(spark)).count() == 0


def test_lifespans(spark):
    spans = drift.lifespans(files(spark, [record({"scroll_y": 1})], [record({"scroll_y": 2})], [record({"scrollY": 2})])).filter("field = 'scroll_y'").orderBy("first_seq").collect()
    assert [(s["first_seq"], s["last_seq"], s["n_files"], s["keys"]) for s in spans] == [(0, 10, 2, ["pageState.scroll_y"]), (20, 20, 1, ["pageState.scrollY"])]


def test_steady_table(spark):
    df = files(spark, [record({"scrollTop": "12.5px", "vpWidth": "768"}, [{"nodeId": 7, "fieldType": ["email"]}, {"id": "x"}])]).withColumns({"record_no": F.lit(1), "received_at": F.lit(None).cast("timestamp")})
    got = [(r["scroll_y"], r["viewport_width"], r["entry_ord"], r["element_id"], r["input_type"]) for r in drift.steady(df).orderBy("entry_ord").collect()]
    assert got == [(12.5, 768, 0, "7", "email"), (12.5, 768, 1, "x", None)]


def test_deep_scan_at_any_depth(spark, tmp_path):
    from veilmark.plans import audit

    deep = "key ghp_" + "a1" * 18
    for i in range(8):
        deep = [deep] if i % 2 else {"k": deep}
    payloads = [
        json.dumps({"deep": deep, "n": 1}),
        json.dumps({"a": {"id": "ghp_" + "b2" * 18, "type": "a@b.example"}, 'q"{[': 'x\\"]}'}),
        json.dumps({"u": "https://x.example/a?token=abc", "v": "https://x.example/a?page=2", "e": [], "t": ""}),
        "{broken",
        None,
    ]
    spark.createDataFrame([(p,) for p in payloads], "payload string").write.parquet(f"{tmp_path}/capture_records.parquet")
    got = {(r["path"], r["code"]): r["n"] for r in audit.deep_scan(spark, str(tmp_path)).collect()}
    assert got == {
        ("deep[].k[].k[].k[].k", "LEAKED_API_KEY"): 1, ("a.id", "LEAKED_SECRET"): 1, ("a.type", "none"): 1, ('q"{[', "none"): 1, ("u", "SENSITIVE_URL_PARAM"): 1, ("v", "none"): 1,
    }


ALIAS = {"n": (None, ("n",), "int"), "x": (None, ("x",), "double"), "a": ("first", ("a", "A"), "string"), "b": ("second", ("in.b",), "int")}


def payload_rows(spark, *payloads):
    rows = [("p", 1, i, None if p is None else p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "producer_id string, file_seq int, record_no int, payload string")


def test_whole_values_or_none(spark):
    """A number is read whole: exponents, groups and units count, a fraction is no whole number, the rest is reported."""
    values = [(12, 12.0), ("1,280", 1280.5), ("1280px", "1.5e7"), (12.7, "1.2e3"), ("12abc", "x1"), ("1,28", ".5"), (True, "-3.25 px"), (None, None)]
    df = payload_rows(spark, *[{"n": n, "x": x} for n, x in values])
    aliases = {k: v for k, v in ALIAS.items() if v[0] is None}
    got = [(r["n"], r["x"]) for r in drift.steady(df, aliases, ("record_no",)).orderBy("record_no").collect()]
    assert got == [(12, 12.0), (1280, 1280.5), (1280, 1.5e7), (None, 1200.0), (None, None), (None, 0.5), (None, -3.25), (None, None)]
    lost = {r["field"]: r["n"] for r in drift.unread(df, aliases).collect()}
    assert lost == {"n": 4, "x": 1}


def test_several_arrays_and_unknown_keys(spark):
    df = payload_rows(spark, {"n": 1, "first": [{"a": "u", "z": 0}, {"A": "v"}], "second": [{"in": {"b": 5, "c": 6}}]}, {"n": 2, "new": 3}, None, "{")
    got = {(r["record_no"], r["array"], r["entry_ord"], r["n"], r["a"], r["b"]) for r in drift.steady(df, ALIAS, ("record_no",)).collect()}
    assert got == {(0, "first", 0, 1, "u", None), (0, "first", 1, 1, "v", None), (0, "second", 0, 1, None, 5), (1, None, None, 2, None, None), (2, None, None, None, None, None), (3, None, None, None, None, None)}
    unknown = {(r["place"], r["key"]) for r in drift.unknown_keys(df, ALIAS).collect()}
    assert unknown == {("first[]", "z"), ("second[].in", "c"), ("", "new")}
    assert drift.unknown_keys(df.limit(0), ALIAS).count() == drift.unread(df.limit(0), ALIAS).count() == 0
