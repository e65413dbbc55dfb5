"""Telemetry tables: counters, latest values, liveness, recent events, sessions, changes of state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED = ("email", "phone", "password", "face", "id", "sensitive")


def type_counts(regions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Regions by type; types outside the counted ones fold into sensitive."""
    folded = F.when(F.col("type").isin(*COUNTED), F.col("type")).otherwise(F.lit("sensitive"))
    return regions.groupBy(*by, folded.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last row: a max_by, not a sort."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return rows.groupBy(*key).agg(last).select(*key, *[F.col(f"v.{c}").alias(c) for c in values])


def liveness(beats: DataFrame, key: str, ts: str, now: Column, limit_s: int = 30) -> DataFrame:
    """(key, last_seen, seconds_since, connected): connected while less than limit_s seconds have passed."""
    seen = beats.groupBy(key).agg(F.max(ts).alias("last_seen"))
    since = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1e6
    return seen.select(key, "last_seen", F.round(since, 3).alias("seconds_since"), (since < limit_s).alias("connected"))


def recent(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows: a distributed top-n, no sort of the whole."""
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def ring(rows: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def changes(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before; a first row is no change."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("before", before).filter(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col(value)))


def quiet_spans(rows: DataFrame, key: str, ts: str, quiet: str, longest: str | None = None) -> DataFrame:
    """Spans of activity that a gap of `quiet` ends; given up after `longest`."""
    w = F.session_window(ts, quiet)
    spans = rows.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    end = F.col("w.end")
    if longest:
        end = F.least(end, F.col("w.start") + F.expr(f"INTERVAL {longest}"))
    return spans.select(key, F.col("w.start").alias("start"), end.alias("end"), "n")


def islands(rows: DataFrame, key: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive rows for which flag holds: (key, island, first, last, n)."""
    w = Window.partitionBy(*key).orderBy(order)
    f = rows.withColumn("__f", F.coalesce(flag, F.lit(False)))
    f = f.withColumn("__new", (F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("__new").over(w))
    return f.filter("__f").groupBy(*key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
