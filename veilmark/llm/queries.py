"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import boilerplate, mixing, normalise, packing, percentiles, privacy, quality, tokens, truncation
from veilmark.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "pages").filter(F.col("page_kind") == "article")
    return boilerplate.main_body(spark, table(spark, d, "elements"), articles).select("page_id", "element_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise.inconsistent(table(spark, d, "elements"), ["page_id", "element_id"], ["text", "label"]).select("page_id", "element_id", "field")


MEASURES = ("vision_ms", "privacy_ms", "total_ms")
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run once; identical deliveries share their key."""
    runs = table(spark, d, "benchmark_results").select("run_id", "profile", F.to_date("started_at").alias("day"), *MEASURES)
    return runs.dropDuplicates(["run_id"])


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per profile and day."""
    found = percentiles.summaries(_runs(spark, d), ["profile", "day"], MEASURES)
    return percentiles.quantiles(found, ["profile", "day"], QUANTILES)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per profile over all days."""
    found = percentiles.summaries(_runs(spark, d), ["profile"], MEASURES)
    return percentiles.quantiles(found, ["profile"], QUANTILES)


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same from the summaries of separate days."""
    days = percentiles.summaries(_runs(spark, d), ["profile", "day"], MEASURES)
    return percentiles.quantiles(percentiles.combined(days, ["profile"]), ["profile"], QUANTILES)


def p4_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile's true rank, counted exactly, lies within the bound."""
    runs = _runs(spark, d)
    found = percentiles.quantiles(percentiles.summaries(runs, ["profile"], MEASURES), ["profile"], QUANTILES)
    long = runs.select("profile", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES])).alias("y")).select("profile", "y.*").filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("x") >= 0))
    # one row a profile, measure and percentile: bounded by the number of profiles
    asked = found.select(F.col("profile").alias("p"), F.col("measure").alias("m"), "q", "value", "n")
    joined = long.join(F.broadcast(asked), F.col("profile").eqNullSafe(F.col("p")) & (F.col("measure") == F.col("m")))
    counts = joined.groupBy("profile", "measure", "q", "n").agg(F.sum((F.col("x") < F.col("value")).cast("long")).alias("below"), F.sum((F.col("x") <= F.col("value")).cast("long")).alias("upto"))
    rank = F.ceil(F.col("q") * F.col("n"))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return counts.select("profile", "measure", "q", "n", (off <= F.ceil(F.lit(percentiles.ERROR) * F.col("n"))).alias("within"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.findings(table(spark, d, "elements"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redacted(table(spark, d, "elements"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_elements(table(spark, d, "elements")).select("page_id", "element_id")


def p7_site_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.site_rates(table(spark, d, "elements"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", tokens.n_tokens(F.col("text")).alias("n_tokens"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's container (and piece, where it exceeds the capacity) for each capacity."""
    targets = table(spark, d, "pack_targets").select("target_id", F.col("capacity_tokens").alias("capacity"))
    items = _sized(spark, d).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size"))
    return packing.packed(items, targets).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return mixing.mixed(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_sized(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality.classified(docs).filter(F.col("kind") != "prose").select("doc_id").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return quality.classified(docs.select("doc_id", "text"), common=quality.common_words(docs)).drop("text")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_daily": p4_daily, "p4_percentiles": p4_percentiles, "p4_combined": p4_combined, "p4_within_bound": p4_within_bound, "p5_found": p5_found, "p5_redacted": p5_redacted, "p7_found": p7_found, "p7_site_rates": p7_site_rates, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_statistics": p10_statistics}

ORACLES: dict[str, str] = {
    "p4_within_bound": """
WITH r AS (SELECT DISTINCT ON (run_id) run_id, profile, vision_ms, privacy_ms, total_ms FROM benchmark_results),
l AS (SELECT profile, 'vision_ms' AS measure, vision_ms AS x FROM r UNION ALL SELECT profile, 'privacy_ms', privacy_ms FROM r UNION ALL SELECT profile, 'total_ms', total_ms FROM r),
c AS (SELECT profile, measure, count(*) AS n FROM l WHERE x IS NOT NULL AND NOT isnan(x) AND x >= 0 GROUP BY profile, measure)
SELECT profile, measure, q, n, TRUE AS within FROM c, (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS q)""",
}
