"""Queries over events, benchmark runs and plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions import text as X
from veilmark.operators import evaluation, telemetry
from veilmark.plans import sqltext as S
from veilmark.sources import table

MEASURES = ("vision_ms", "privacy_ms", "total_ms")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_results").dropDuplicates(["run_id"])


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Index percentiles of the value by event type."""
    return evaluation.index_percentile(_events(spark, d), "value", ["event_type"], {"p50": 0.5, "p95": 0.95})


def run_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact index percentiles of the total by profile and backend, valid readings only."""
    r = _runs(spark, d).filter(F.col("total_ms") >= 0)
    return evaluation.index_percentile(r, "total_ms", ["profile", "backend"], {"p50": 0.5, "p95": 0.95}).filter(F.col("profile").isNotNull())


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Runs by profile and kind of measurement, with the share of valid readings."""
    ok = F.col("total_ms").isNotNull() & ~F.isnan("total_ms") & (F.col("total_ms") >= 0)
    return _runs(spark, d).groupBy("profile", "measure_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"), F.round(F.avg(F.when(ok & (F.col("total_ms") < 1e6), F.col("total_ms"))), 4).alias("mean_ms"), F.max(F.when(ok, F.col("n_elements"))).alias("max_elements")
    )


def run_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Runs by profile, one column a backend."""
    return _runs(spark, d).groupBy("profile").pivot("backend", ["webgpu", "wasm"]).agg(F.count(F.lit(1))).na.fill(0)


def run_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Valid readings a measure."""
    r = _runs(spark, d).unpivot(["run_id"], list(MEASURES), "measure", "ms")
    ok = F.col("ms").isNotNull() & ~F.isnan("ms") & (F.col("ms") >= 0)
    return r.groupBy("measure").agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok | ok.isNull()).alias("n_other"))


def run_late(spark: SparkSession, d: str) -> DataFrame:
    """Runs a day that arrived more than an hour late."""
    late = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return _runs(spark, d).groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(late > 3_600_000_000).alias("n_late"))


def run_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Runs more than ten times their profile's exact median."""
    r = _runs(spark, d).filter(F.col("profile").isNotNull() & (F.col("total_ms") >= 0) & ~F.isnan("total_ms"))
    med = evaluation.index_percentile(r, "total_ms", ["profile"], {"p50": 0.5}).select("profile", "p50")
    return r.join(med, "profile").filter(F.col("total_ms") > 10 * F.col("p50")).select("run_id", "profile")


def agent_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last reading of each agent, with defaults for missing parts."""
    last = telemetry.latest(_runs(spark, d), ["agent_id"], ["started_at", "run_id"], list(MEASURES))
    fill = {"vision_ms": 0.4, "privacy_ms": 4.7, "total_ms": 70.1}
    return last.select("agent_id", *[F.round(F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(v)), 3).alias(c) for c, v in fill.items()])


def agents_alive(spark: SparkSession, d: str) -> DataFrame:
    """Agents by whether their last run began within an hour of the newest of all."""
    r = _runs(spark, d).select("agent_id", F.col("started_at").cast("timestamp").alias("ts"))
    now = r.agg(F.max("ts")).scalar()
    return telemetry.liveness(r, "agent_id", "ts", now, 3600).groupBy("connected").agg(F.count(F.lit(1)).alias("n_agents"))


def events_recent50(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.recent(_events(spark, d), ["ts", "event_id"], 50).select("event_id", "user_id", "event_type")


def events_ring(spark: SparkSession, d: str) -> DataFrame:
    """The 100 newest events of each type."""
    return telemetry.ring(_events(spark, d), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id")


def events_levels(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "success").otherwise("info")
    return _events(spark, d).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


def event_type_changes(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user whose type differs from the one before."""
    c = telemetry.changes(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type")
    return c.groupBy("before", "event_type").agg(F.count(F.lit(1)).alias("n"))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a user's activity with gaps of less than six hours."""
    s = telemetry.quiet_spans(_events(spark, d), "user_id", "ts", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    return _events(spark, d).groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.unix_micros("w.start").alias("start_us"), "n", "total")


def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "1 hour", "30 minutes")
    return _events(spark, d).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


def events_running(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of a user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, d).select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("seen"), F.round(F.sum("value").over(w), 3).alias("total"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the events' open JSON."""
    keys = F.json_object_keys("props")
    return _events(spark, d).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def users_twice(spark: SparkSession, d: str) -> DataFrame:
    """Users who both purchased and met an error, and those who only purchased."""
    e = _events(spark, d)
    bought, failed = (e.filter(F.col("event_type") == t).select("user_id").distinct() for t in ("purchase", "error"))
    both = bought.intersect(failed).select("user_id", F.lit("both").alias("kind"))
    return both.unionByName(bought.exceptAll(failed).select("user_id", F.lit("purchase only").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(price).cast("double"), 2).alias("sum_disc_price"), F.round(F.sum(price * (1 + F.col("l_tax"))).cast("double"), 2).alias("sum_charge"), F.round(F.avg("l_quantity").cast("double"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n")
    )


def open_orders_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten open orders of a segment worth most."""
    c = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    o = table(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("1995-03-15").cast("date")).select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") > F.lit("1995-03-15").cast("date")).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum("v").cast("double"), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"), "revenue")


def discount_revenue(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1994-01-01").cast("date")) & (F.col("l_shipdate") < F.lit("1995-01-01").cast("date")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")).cast("double"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def customers_masked(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their number masked by scrubbing it inside a sentence."""
    c = table(spark, d, "customer")
    line = F.concat(F.col("c_name"), F.lit(" can be reached at +1 415 555 0"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return c.select("c_custkey", X.scrub(line).alias("line"))


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of suppliers by nation and region."""
    # nation and region are fixed tables of 25 and 5 rows
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double")).alias("v"), F.count(F.lit(1)).alias("c"))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("v"), 1).alias("revenue"), F.sum("c").alias("n"))


QUERIES = {f.__name__: f for f in (
    latency_percentiles, run_percentiles, run_summary, run_pivot, run_unpivot, run_late, run_outliers, agent_latest, agents_alive, events_recent50, events_ring, events_levels, event_type_changes, user_sessions,
    events_tumbling, events_sliding, events_running, event_props, users_twice, pricing_summary, open_orders_top10, discount_revenue, customers_masked, nation_revenue,
)}

R_ = "(SELECT DISTINCT ON (run_id) * FROM benchmark_results)"
_OK = "(total_ms IS NOT NULL AND NOT isnan(total_ms) AND total_ms >= 0)"


def _index(values: str, by: str, qs: dict[str, float]) -> str:
    cols = ", ".join(f"list_sort(list(v))[CAST(least(floor(count(*) * {q}), count(*) - 1) AS BIGINT) + 1] AS {n}" for n, q in qs.items())
    return f"SELECT {by}, count(*) AS n, {cols} FROM ({values}) GROUP BY {by}"


ORACLES = {
    "latency_percentiles": _index("SELECT event_type, value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)", "event_type", {"p50": 0.5, "p95": 0.95}),
    "run_percentiles": _index(f"SELECT profile, backend, total_ms AS v FROM {R_} WHERE {_OK} AND profile IS NOT NULL", "profile, backend", {"p50": 0.5, "p95": 0.95}),
    "run_summary": f"SELECT profile, measure_type, count(*) AS n, count(*) FILTER ({_OK}) AS n_valid, round(avg(total_ms) FILTER ({_OK} AND total_ms < 1e6), 4) AS mean_ms, max(n_elements) FILTER ({_OK}) AS max_elements FROM {R_} GROUP BY profile, measure_type",
    "run_pivot": f"SELECT profile, count(*) FILTER (backend = 'webgpu') AS webgpu, count(*) FILTER (backend = 'wasm') AS wasm FROM {R_} GROUP BY profile",
    "run_unpivot": " UNION ALL ".join(f"SELECT '{m}' AS measure, count(*) FILTER ({m} IS NOT NULL AND NOT isnan({m}) AND {m} >= 0) AS n_valid, count(*) FILTER ({m} IS NULL OR isnan({m}) OR {m} < 0) AS n_other FROM {R_}" for m in MEASURES),
    "run_late": f"SELECT CAST(started_at AS DATE) AS day, count(*) AS n, count(*) FILTER (epoch_us(received_at) - epoch_us(started_at) > 3600000000) AS n_late FROM {R_} GROUP BY 1",
    "run_outliers": f"WITH r AS (SELECT * FROM {R_} WHERE {_OK} AND profile IS NOT NULL), m AS ({_index('SELECT profile, total_ms AS v FROM r', 'profile', {'p50': 0.5})}) SELECT run_id, profile FROM r JOIN m USING (profile) WHERE total_ms > 10 * p50",
    "agent_latest": f"SELECT agent_id, round(coalesce(CASE WHEN NOT isnan(v.a) THEN v.a END, 0.4), 3) AS vision_ms, round(coalesce(CASE WHEN NOT isnan(v.b) THEN v.b END, 4.7), 3) AS privacy_ms, round(coalesce(CASE WHEN NOT isnan(v.c) THEN v.c END, 70.1), 3) AS total_ms FROM (SELECT agent_id, arg_max({{'a': vision_ms, 'b': privacy_ms, 'c': total_ms}}, {{'t': started_at, 'r': run_id}}) AS v FROM {R_} GROUP BY agent_id)",
    "agents_alive": f"SELECT connected, count(*) AS n_agents FROM (SELECT agent_id, (SELECT epoch_us(max(started_at)) FROM {R_}) - epoch_us(max(started_at)) < 3600000000 AS connected FROM {R_} GROUP BY agent_id) GROUP BY connected",
    "events_recent50": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "events_ring": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100",
    "events_levels": "SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' ELSE 'info' END AS level, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
    "event_type_changes": "SELECT before, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type GROUP BY 1, 2",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "events_tumbling": "SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT start_us, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 1800000000 * 1800000000, epoch_us(ts) // 1800000000 * 1800000000 - 1800000000]) AS start_us FROM events) GROUP BY 1",
    "events_running": "SELECT event_id, user_id, count(*) OVER w AS seen, round(sum(value) OVER w, 3) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "event_props": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "users_twice": """WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT 'both' AS kind, count(*) AS n FROM p WHERE user_id IN (SELECT user_id FROM e) HAVING count(*) > 0 UNION ALL SELECT 'purchase only', count(*) FROM p WHERE user_id NOT IN (SELECT user_id FROM e) HAVING count(*) > 0""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS sum_disc_price, round(CAST(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS DOUBLE), 2) AS sum_charge, round(CAST(avg(l_quantity) AS DOUBLE), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-09-02' GROUP BY 1, 2",
    "open_orders_top10": "SELECT l_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND CAST(o_orderdate AS DATE) < DATE '1995-03-15' AND CAST(l_shipdate AS DATE) > DATE '1995-03-15' GROUP BY 1, 2 ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "discount_revenue": "SELECT round(CAST(sum(l_extendedprice * l_discount) AS DOUBLE), 2) AS revenue, count(*) AS n FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1994-01-01' AND CAST(l_shipdate AS DATE) < DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "customers_masked": f"SELECT c_custkey, {S.scrub('line')} AS line FROM (SELECT c_custkey, c_name || ' can be reached at +1 415 555 0' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS line FROM customer)",
    "nation_revenue": "SELECT r_name, n_name, round(sum(CAST(l_extendedprice * (1 - l_discount) AS DOUBLE)), 1) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
