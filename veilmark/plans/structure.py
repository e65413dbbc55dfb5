"""Queries of the core data-shaping problems: nested records (p3) and drifting schemas (p6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators import drift, shredding
from veilmark.plans import sqltext as S
from veilmark.sources import table

REFERENCES = {"redactions.element_ids": "dom.element_id", "step_history.action.target": "dom.element_id"}


def _shredded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return shredding.shred(table(spark, d, "agent_requests"), "requests", "request_id", references=REFERENCES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = _shredded(spark, d)
    ids, steps = t["redactions__element_ids"], t["step_history"]
    refs = ids.filter(~F.col("entry_null")).select("request_id", F.lit("redactions").alias("child"), F.col("redactions_ord").alias("child_ord"), F.col("value").alias("element_id"), F.col("dom_ref_ord").alias("dom_ord"))
    acts = steps.filter(F.col("action_target").isNotNull()).select("request_id", F.lit("step_history").alias("child"), F.col("step_history_ord").alias("child_ord"), F.col("action_target").alias("element_id"), F.col("action_target_dom_ref_ord").alias("dom_ord"))
    return refs.unionByName(acts).distinct()


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every flat table, each child counted once."""
    parts = None
    for name, t in _shredded(spark, d).items():
        keyed = t.select("request_id", (F.col("row_id") if "row_id" in t.columns else F.lit("")).alias("row_id")).distinct()
        n = keyed.groupBy().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        parts = n if parts is None else parts.unionByName(n)
    return parts


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "capture_records")).select("producer_id", "file_seq", "field", "change")


def p6_lifespans(spark: SparkSession, d: str) -> DataFrame:
    spans = drift.lifespans(table(spark, d, "capture_records"))
    return spans.select("producer_id", "field", F.array_join("keys", "|").alias("keys"), F.array_join("types", "|").alias("types"), "first_seq", "last_seq", "n_files")


def p6_steady(spark: SparkSession, d: str) -> DataFrame:
    return drift.steady(table(spark, d, "capture_records")).distinct()


def p6_unread(spark: SparkSession, d: str) -> DataFrame:
    """Values that the steady table could not take over, by file."""
    return drift.unread(table(spark, d, "capture_records").distinct())


def p6_unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys beside the aliased ones, with the number of producers and records that have them."""
    found = drift.unknown_keys(table(spark, d, "capture_records").distinct())
    return found.groupBy("place", "key").agg(F.count_distinct("producer_id").alias("n_producers"), F.sum("n").alias("n_records"))


QUERIES = {f.__name__: f for f in (p3_found, p3_tables, p6_found, p6_lifespans, p6_steady, p6_unread, p6_unknown_keys)}


def _drift_states_sql() -> str:
    """CTEs up to l: a row a file and field with its keys and types, and those of the file before."""
    parts = []
    for field, (inside, keys, _) in drift.ALIASES.items():
        for k in keys:
            path = "$" + "".join(f'."{x}"' for x in k.split("."))
            source = "c" if inside is None else "el"
            column = "payload" if inside is None else "e"
            parts.append(f"SELECT producer_id, file_seq, '{field}' AS field, '{k}' AS key, json_type({column}, '{path}') AS t FROM {source}")
    return f"""
WITH c AS (SELECT producer_id, file_seq, payload FROM capture_records WHERE payload IS NOT NULL),
el AS (SELECT producer_id, file_seq, unnest(json_extract(payload, '$.elements[*]')) AS e FROM c),
i AS (SELECT producer_id, file_seq, field, list_sort(list_distinct(list(key))) AS keys, list_sort(list_distinct(list(CASE WHEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END))) AS types
      FROM ({' UNION ALL '.join(parts)}) WHERE t IS NOT NULL AND t <> 'NULL' GROUP BY ALL),
g AS (SELECT producer_id, file_seq, field FROM (SELECT DISTINCT producer_id, file_seq FROM capture_records), (SELECT unnest(['scroll_y', 'viewport_width', 'element_id', 'input_type']) AS field)),
s AS (SELECT g.*, coalesce(i.keys, []) AS keys, coalesce(i.types, []) AS types FROM g LEFT JOIN i USING (producer_id, file_seq, field)),
l AS (SELECT *, lag(keys) OVER w AS pk, lag(types) OVER w AS pt FROM s WINDOW w AS (PARTITION BY producer_id, field ORDER BY file_seq))"""


def _drift_sql() -> str:
    return f"""{_drift_states_sql()}
SELECT producer_id, file_seq, field, 'added' AS change FROM l WHERE len(pk) = 0 AND len(keys) > 0
UNION ALL SELECT producer_id, file_seq, field, 'removed' FROM l WHERE len(pk) > 0 AND len(keys) = 0
UNION ALL SELECT producer_id, file_seq, field, 'renamed' FROM l WHERE len(pk) > 0 AND len(keys) > 0 AND pk <> keys
UNION ALL SELECT producer_id, file_seq, field, 'retyped' FROM l WHERE len(pk) > 0 AND len(keys) > 0 AND pt <> types"""


LIFESPANS_SQL = _drift_states_sql() + """,
n AS (SELECT *, sum(CASE WHEN pk IS NULL OR pk <> keys OR pt <> types THEN 1 ELSE 0 END) OVER (PARTITION BY producer_id, field ORDER BY file_seq) AS island FROM l)
SELECT producer_id, field, any_value(array_to_string(keys, '|')) AS keys, any_value(array_to_string(types, '|')) AS types, min(file_seq) AS first_seq, max(file_seq) AS last_seq, count(*) AS n_files
FROM n GROUP BY producer_id, field, island"""


def _text_sql(at: str, keys: Sequence[str]) -> str:
    """The value of the first key that holds one, out of a list where need be."""
    one = []
    for k in keys:
        path = "$" + "".join(f'."{x}"' for x in k.split("."))
        one.append(f"CASE json_type({at}, '{path}') WHEN 'ARRAY' THEN json_extract_string({at}, '{path}[0]') WHEN 'NULL' THEN NULL ELSE json_extract_string({at}, '{path}') END")
    return f"coalesce({', '.join(one)})"


def _number_sql(text: str, whole: bool) -> str:
    number = f"TRY_CAST(CASE WHEN regexp_matches(trim({text}), {S.quote(drift.NUMBER)}) THEN regexp_replace(replace(trim({text}), ',', ''), '[^0-9]*$', '') END AS DOUBLE)"
    return f"CASE WHEN {number} = floor({number}) THEN TRY_CAST({number} AS INTEGER) END" if whole else number


def _steady_sql(select: str) -> str:
    a = drift.ALIASES
    return f"""WITH c AS (SELECT DISTINCT producer_id, file_seq, record_no, received_at, payload FROM capture_records),
r AS (SELECT producer_id, file_seq, record_no, received_at, payload, unnest(CASE WHEN coalesce(json_array_length(payload, '$.elements'), 0) > 0 THEN range(CAST(json_array_length(payload, '$.elements') AS BIGINT)) ELSE [NULL] END) AS i FROM c),
e AS (SELECT *, CASE WHEN i IS NOT NULL THEN json_extract(payload, '$.elements[' || i || ']') END AS e FROM r),
t AS (SELECT producer_id, file_seq, record_no, received_at, CAST(i AS INTEGER) AS entry_ord, {', '.join(f"{_text_sql('e' if inside else 'payload', keys)} AS {f}" for f, (inside, keys, _) in a.items())} FROM e)
{select}"""


STEADY_SQL = _steady_sql(f"SELECT DISTINCT producer_id, file_seq, record_no, received_at, {_number_sql('scroll_y', False)} AS scroll_y, {_number_sql('viewport_width', True)} AS viewport_width, entry_ord, element_id, input_type FROM t")
UNREAD_SQL = _steady_sql(f"""SELECT producer_id, file_seq, field, count(*) AS n, min(text) AS example FROM (
SELECT producer_id, file_seq, 'scroll_y' AS field, scroll_y AS text FROM t WHERE coalesce(entry_ord, 0) = 0 AND scroll_y IS NOT NULL AND ({_number_sql('scroll_y', False)}) IS NULL
UNION ALL SELECT producer_id, file_seq, 'viewport_width', viewport_width FROM t WHERE coalesce(entry_ord, 0) = 0 AND viewport_width IS NOT NULL AND ({_number_sql('viewport_width', True)}) IS NULL) GROUP BY ALL""")


ORACLES = {
    "p6_lifespans": LIFESPANS_SQL,
    "p6_steady": STEADY_SQL,
    "p6_unread": UNREAD_SQL,
    "p3_tables": """
WITH q AS (SELECT DISTINCT ON (request_id) * FROM agent_requests),
d AS (SELECT unnest(dom) AS x FROM q), r AS (SELECT unnest(redactions) AS x FROM q)
SELECT 'requests' AS table_name, count(*) AS n_rows FROM q
UNION ALL SELECT 'dom', count(*) FROM d
UNION ALL SELECT 'dom__attrs', CAST(coalesce(sum(cardinality(x.attrs)), 0) AS BIGINT) FROM d
UNION ALL SELECT 'redactions', count(*) FROM r
UNION ALL SELECT 'redactions__element_ids', CAST(coalesce(sum(len(x.element_ids)), 0) AS BIGINT) FROM r
UNION ALL SELECT 'redactions__merged_from', CAST(coalesce(sum(len(x.provenance.merged_from)), 0) AS BIGINT) FROM r
UNION ALL SELECT 'bbox', (SELECT count(*) FROM d WHERE x.bbox IS NOT NULL) + (SELECT count(*) FROM r WHERE x.bbox IS NOT NULL)
UNION ALL SELECT 'step_history', CAST(coalesce(sum(len(step_history)), 0) AS BIGINT) FROM q""",
    "p6_found": _drift_sql(),
    "p3_found": """
WITH r AS (SELECT DISTINCT request_id, dom, redactions, step_history FROM agent_requests),
ids AS (SELECT *, list_transform(dom, lambda e: e.element_id) AS ids FROM r),
red AS (SELECT request_id, ids, unnest(redactions) AS x, unnest(range(len(redactions))) AS i FROM ids),
refs AS (SELECT request_id, ids, 'redactions' AS child, i, unnest(x.element_ids) AS element_id FROM red),
st AS (SELECT request_id, ids, unnest(step_history) AS x, unnest(range(len(step_history))) AS i FROM ids),
acts AS (SELECT request_id, ids, 'step_history' AS child, i, x.action.target AS element_id FROM st),
u AS (SELECT * FROM refs UNION ALL SELECT * FROM acts)
SELECT DISTINCT request_id, child, CAST(i AS INTEGER) AS child_ord, element_id,
       CAST(coalesce(list_position(ids, element_id), 0) - 1 AS INTEGER) AS dom_ord
FROM u WHERE element_id IS NOT NULL""",
}
