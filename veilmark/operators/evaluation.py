"""Detections held against labels: confusion counts, precision, recall, overlap, index percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn; null flags count as false."""
    a, p = F.coalesce(actual, F.lit(False)), F.coalesce(predicted, F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))


def scores(counts: DataFrame) -> DataFrame:
    """precision (100 without predictions), recall and F1 (0 without labels), in per cent with two decimals."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.withColumns({"precision": F.round(p * 100, 2), "recall": F.round(r * 100, 2), "f1": F.round(f1 * 100, 2)})


def index_percentile(rows: DataFrame, value: str, by: Sequence[str], qs: dict[str, float], parts: int = 64) -> DataFrame:
    """The value at position floor(n * q) of the sorted values, counted from 0: exact, in two steps.

    Approximate quantiles cut each group's values into `parts` ranges; counts of the ranges tell which one holds a
    position, and only that range is ordered. So no task sorts a whole group, however large, and nothing is collected.
    """
    live = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).alias("__v"))
    same = lambda a, b: _same(a, b, by)
    cuts = live.groupBy(*by).agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], F.lit(parts * 8)).alias("__cuts"), F.count(F.lit(1)).alias("n"))
    # values are counted before anything is joined or ordered
    counts = same(live.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("c")), cuts)
    counts = counts.withColumn("__part", F.size(F.filter("__cuts", lambda x: x < F.col("__v")))).drop("__cuts")
    sizes = counts.groupBy(*by, "n", "__part").agg(F.sum("c").alias("size"))
    # at most `parts` rows a group
    before = F.sum("size").over(Window.partitionBy(*by).orderBy("__part")) - F.col("size")
    at = lambda q: F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at(q).alias("at")) for name, q in qs.items()])
    sizes = sizes.withColumn("before", before)
    asked = sizes.select(*by, "__part", "before", F.filter(wanted, lambda w: (w["at"] >= F.col("before")) & (w["at"] < F.col("before") + F.col("size"))).alias("w")).filter(F.size("w") > 0)
    inside = _same(counts, asked, [*by, "__part"])
    upto = F.sum("c").over(Window.partitionBy(*by, "__part").orderBy("__v")) + F.col("before")
    ranked = inside.withColumn("upto", upto).select(*by, "n", "__v", "upto", F.explode("w").alias("w"))
    hit = lambda name: F.min(F.when((F.col("w.name") == name) & (F.col("upto") > F.col("w.at")), F.col("__v"))).alias(name)
    return ranked.groupBy(*by, "n").agg(*[hit(name) for name in qs])


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where null equals null."""
    names = {k: f"__r_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    on = [left[k].eqNullSafe(right[r]) for k, r in names.items()]
    return left.join(right, on).drop(*names.values())


def coverage(truths: DataFrame, regions: DataFrame, page: Sequence[str]) -> DataFrame:
    """One row: n, n_found, mean_iou and coverage in per cent of labelled boxes against the found ones of the same page.

    truths: page, box_id, bbox; regions: page, region_id, bbox. A labelled box counts with the found one that overlaps
    it most, as found where that overlap reaches 0.5; one without any overlap counts 0. No labels give zeros.
    """
    from veilmark.operators import regions as R

    pairs = R.overlapping(truths.withColumnRenamed("box_id", "id_a"), regions.withColumnRenamed("region_id", "id_b"), page, "id_a", "id_b")
    best = pairs.groupBy(*page, "id_a").agg(F.max("iou").alias("iou"))
    rows = truths.select(*page, F.col("box_id").alias("id_a")).join(best, [*page, "id_a"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    found = F.count_if(F.col("iou") >= 0.5)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), found.alias("n_found"), F.round(F.coalesce(F.avg("iou"), F.lit(0.0)) * 100, 2).alias("mean_iou"), F.round(F.when(n > 0, found / n * 100).otherwise(0.0), 2).alias("coverage"))
