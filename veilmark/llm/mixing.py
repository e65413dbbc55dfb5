"""Sources mixed to target weights by hash thresholds.

Every document has a fixed place on a 60-bit hash line. A source takes whole passes over its documents and then those
below a threshold on the line, so a larger budget always takes a superset. The threshold is found with histograms
alone: tokens by source and 10-bit bucket, then the same within the one bucket the budget ends in, and so on until the
bucket cannot be split; nothing is sorted, and what reaches the driver is at most (sources in the targets x 1024)
numbers a level. Budgets are share x size of the mix; a source that cannot reach its share within its repeats gives
all it may and is reported as short, and its shortfall is not filled by others.

Defined cases: null or unlisted sources take no part; share 0 takes nothing; a source without documents is reported
with 0; null texts have no tokens and are not taken; repeated ids share a place on the line and are taken together;
a tie in the hash is taken or left as one; an empty table gives a report of zeros; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.session import cut

BITS, LEVELS = 10, 6
SPAN = 1 << (BITS * LEVELS)


@dataclass
class Plan:
    source: str
    share: float
    max_repeats: int
    available: int
    budget: int
    passes: int = 0
    rest: int = 0
    threshold: int = 0
    short: bool = False


def placed(documents: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, place) with place in [0, 2^60)."""
    return documents.select("doc_id", "source", "n_tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SPAN)).alias("place"))


def _plan(available: dict[str, int], targets: list, size: int | None) -> list[Plan]:
    shares = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets]
    total = size if size is not None else sum(available.get(s, 0) for s, share, _ in shares if share > 0)
    plans = []
    for source, share, repeats in shares:
        have = available.get(source, 0)
        p = Plan(source, share, repeats, have, round(share * total))
        if have > 0 and p.budget > 0:
            p.passes, p.rest = divmod(p.budget, have)
            if p.passes >= repeats:
                p.short = p.budget > repeats * have
                p.passes, p.rest = repeats, 0
        else:
            p.short = p.budget > 0
        plans.append(p)
    return plans


def _thresholds(docs: DataFrame, plans: list[Plan]) -> None:
    """Sets the threshold of each plan with a rest: the largest place whose cumulative tokens stay within it."""
    spark = docs.sparkSession
    open_plans = {p.source: p for p in plans if p.rest > 0}
    base = {s: 0 for s in open_plans}
    left = {s: p.rest for s, p in open_plans.items()}
    for level in range(LEVELS):
        if not open_plans:
            return
        width = SPAN >> (BITS * (level + 1))
        # sources of the targets only: bounded by that table
        bounds = spark.createDataFrame([(s, base[s]) for s in open_plans], "source string, low long")
        inside = docs.join(F.broadcast(bounds), "source").filter((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(width << BITS)))
        bucket = F.floor((F.col("place") - F.col("low")) / F.lit(width)).cast("int") if width > 1 else (F.col("place") - F.col("low")).cast("int")
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in hist:
            by.setdefault(r["source"], {})[r["bucket"]] = (r["tokens"], r["n"])
        for s in list(open_plans):
            at = None
            for b in sorted(by.get(s, {})):
                tokens, n = by[s][b]
                if tokens > left[s]:
                    at = (b, n, tokens)
                    break
                left[s] -= tokens
            if at is None:
                # everything in this stretch fits
                open_plans[s].threshold = base[s] + (width << BITS)
                del open_plans[s]
                continue
            base[s] += at[0] * width
            if at[1] == 1 or width == 1:
                # one document (or one tie) is left at the boundary: take it where that comes nearer
                open_plans[s].threshold = base[s] + (width if at[2] - left[s] < left[s] else 0)
                del open_plans[s]


def mixed(documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 42) -> tuple[DataFrame, list[Plan]]:
    """((doc_id, source, n_tokens, n_copies) of the documents taken, the plans). documents: (doc_id, source, n_tokens).

    size: tokens of the mix; by default those of all documents of sources with a share.
    """
    rows = targets.collect()
    listed = [r["source"] for r in rows if r["source"] is not None]
    docs = cut(placed(documents.filter(F.col("n_tokens") > 0).filter(F.col("source").isin(listed)), seed))
    available = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plans = _plan(available, [r for r in rows if r["source"] is not None], size)
    _thresholds(docs, plans)
    spark: SparkSession = documents.sparkSession
    table = spark.createDataFrame([(p.source, p.passes, p.threshold) for p in plans if p.passes or p.threshold], "source string, passes int, threshold long")
    copies = F.col("passes") + (F.col("place") < F.col("threshold")).cast("int")
    taken = docs.join(F.broadcast(table), "source").withColumn("n_copies", copies).filter(F.col("n_copies") > 0)
    return taken.select("doc_id", "source", "n_tokens", "n_copies"), plans


def shares(documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 42) -> DataFrame:
    """One row a source of the targets: budget, tokens taken, target and actual share, and whether it fell short."""
    taken, plans = mixed(documents, targets, size, seed)
    spark = documents.sparkSession
    planned = spark.createDataFrame([(p.source, p.share, p.max_repeats, p.available, p.budget, p.short) for p in plans], "source string, target_share double, max_repeats int, available_tokens long, budget_tokens long, short boolean")
    sums = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.sum("n_copies").alias("n_documents"), F.max("n_copies").alias("most_copies"))
    rows = planned.join(F.broadcast(sums), "source", "left").fillna(0, ["tokens", "n_documents", "most_copies"])
    # one row a source of the targets
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
