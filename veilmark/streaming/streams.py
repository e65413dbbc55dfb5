"""Structured Streaming forms of the telemetry operators.

Every query here has a batch equal: run with `availableNow` over the same files it gives the same rows. State is
bounded by the watermark; sinks are parquet with a checkpoint, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from veilmark.operators import sanitising

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over parquet files, with ts as a timestamp."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    w = F.window("ts", size).alias("w")
    return events.withWatermark("ts", late).groupBy("event_type", w).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = LATE) -> DataFrame:
    w = F.window("ts", size, slide).alias("w")
    return events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each event once, whatever is delivered again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_counts(events: DataFrame) -> DataFrame:
    """Counters by type, for update or complete mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def liveness(beats: DataFrame, key: str, limit_s: int = 30, late: str = LATE) -> DataFrame:
    """(key, state, at): connected at a key's first beat, disconnected when none came for limit_s of event time, connected again after."""
    schema = f"`{key}` {beats.schema[key].dataType.simpleString()}, state string, at timestamp"

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append((k[0], "disconnected", pd.Timestamp(last + limit_s * 1_000_000, unit="us")))
            state.remove()
        else:
            stamps = sorted(int(pd.Timestamp(t).value // 1000) for batch in rows for t in batch["ts"])
            for t in stamps:
                if last is None:
                    out.append((k[0], "connected", pd.Timestamp(t, unit="us")))
                elif t - last >= limit_s * 1_000_000:
                    out.append((k[0], "disconnected", pd.Timestamp(last + limit_s * 1_000_000, unit="us")))
                    out.append((k[0], "connected", pd.Timestamp(t, unit="us")))
                last = t if last is None else max(last, t)
            state.update((last,))
            state.setTimeoutTimestamp(max((last + limit_s * 1_000_000) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "state", "at"])

    return beats.select(key, "ts").withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def split_safe(elements: DataFrame, safe: str, quarantine: str, checkpoint: str):
    """A stream of elements split page by page: safe ones to one table, refused ones to the other.

    A page may come in several micro-batches. Once a batch of it is refused, all later ones go to quarantine; what was
    written before stays in the safe table, but `released` does not return it. Readers take `released`, not the table.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        verdicts = sanitising.page_verdicts(batch).select("page_id", "safe")
        refused = _refused(spark, quarantine, epoch)
        if refused is not None:
            verdicts = verdicts.join(refused.withColumn("__r", F.lit(True)), "page_id", "left").select("page_id", (F.col("safe") & F.col("__r").isNull()).alias("safe"))
        judged = batch.join(verdicts, "page_id")
        # one folder an epoch: a repeated epoch overwrites its own rows
        judged.filter("NOT safe").drop("safe").write.mode("overwrite").parquet(f"{quarantine}/epoch={epoch}")
        judged.filter("safe").drop("safe").write.mode("overwrite").parquet(f"{safe}/epoch={epoch}")

    return elements.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _refused(spark: SparkSession, quarantine: str, epoch: int) -> DataFrame | None:
    """Pages that epochs before this one refused; None before the first."""
    try:
        return spark.read.parquet(quarantine).filter(F.col("epoch") < epoch).select("page_id").distinct()
    except AnalysisException:
        return None


def released(spark: SparkSession, safe: str, quarantine: str) -> DataFrame:
    """The safe rows of pages of which no batch was ever refused."""
    return spark.read.parquet(safe).join(spark.read.parquet(quarantine).select("page_id").distinct(), "page_id", "left_anti")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Everything available now, to parquet."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def collect_available(df: DataFrame, name: str, mode: str = "complete", each: Callable | None = None) -> DataFrame:
    """Everything available now, into a memory table: for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if each:
        each(q)
    return df.sparkSession.table(name)
