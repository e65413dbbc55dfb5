"""Main body of pages: flat text blocks classified by a decision tree.

Every element of a page is a block in document order. Its features are shallow: words of the block and of its
neighbours, link density around it, column position, place relative to the page's title, and the log-odds of its
opening words, learned from a small labelled table (data/labelled_blocks.tsv, a bounded file in the package). A CART
tree is fitted on that table on the driver and turned into one nested CASE expression, so the pages are classified
inside the JVM: one shuffle of the blocks by page, windows in that partitioning, no Python.

Defined cases: null or empty text is a block of zero words (it counts as a neighbour, and is never returned); null or
NaN boxes are an unknown position; identical rows are one block; ties of `ord` are ordered by element id; pages
without a title block have no main body by position, only by wording; empty tables give empty results; extra columns
are ignored. A page's blocks are sorted within one task with spilling; no list of them is built.
"""

from __future__ import annotations

import math
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.letters import plain

FEATURES = (
    "n_words", "is_link", "tag_class", "ends", "x", "prev_x", "next_x", "open_score", "open_prev", "open_next", "words_prev", "words_next", "words_prev2", "words_next2",
    "links_2", "links_5", "after_title", "since_title", "boiler_before", "boiler_next", "body_after",
)
UNKNOWN_X = -1.0


def folded(text: Column) -> Column:
    """Lower case in plain letters."""
    return F.lower(plain(text))


def tag_class(tag: Column) -> Column:
    classes = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li",), ("td", "th"), ("blockquote", "figcaption", "q", "cite"), ("div", "span", "section"), ("a",))
    out = F.lit(float(len(classes)))
    for i, names in reversed(list(enumerate(classes))):
        out = F.when(tag.isin(*names), F.lit(float(i))).otherwise(out)
    return out


def blocks(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a block of the given pages, with what concerns the block alone."""
    # partitioned by page before anything else: duplicates, the join and all windows then need no other shuffle
    e = elements.select("page_id", "element_id", "ord", "tag", "text", "href", "bbox.x").repartition("page_id").distinct()
    # a page listed with several titles keeps one
    p = pages.select("page_id", F.regexp_replace("title", r"\s+\|[^|]*$", "").alias("title"))
    p = p.groupBy("page_id").agg(folded(F.min("title")).alias("title"))
    b = e.join(p, "page_id").withColumn("t", folded(F.coalesce("text", F.lit(""))))
    words = F.split("t", " ")
    own = F.when(F.col("t") == "", 0).otherwise(F.size(words)).cast("double")
    href = F.coalesce(F.trim("href"), F.lit(""))
    return b.select(
        "page_id", "element_id", "ord", "text",
        own.alias("n_words"),
        ((href != "") | F.col("tag").isin("a", "button", "input", "select", "textarea", "label")).cast("double").alias("is_link"),
        tag_class(F.col("tag")).alias("tag_class"),
        F.col("t").rlike("[.!?:;…\"”»]$").cast("double").alias("ends"),
        F.when(F.col("x").isNull() | F.isnan("x"), None).otherwise(F.col("x")).alias("known_x"),
        F.array_join(F.slice(words, 1, 3), " ").alias("opening"),
        ((F.col("tag") == "h1") | ((F.col("t") == F.col("title")) & (F.col("t") != "") & (href == "") & (F.col("tag") != "a"))).cast("double").alias("is_title"),
    )


def featured(b: DataFrame) -> DataFrame:
    """Adds the features that look at neighbours; b has open_score."""
    w = Window.partitionBy("page_id").orderBy("ord", "element_id")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    at = lambda c, k, default=0.0: F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w), F.lit(default))
    near = lambda c, k: F.avg(c).over(w.rowsBetween(-k, k))
    titled = F.max("is_title").over(before)
    b = b.withColumn("after_title", titled).withColumn("boiler", (F.col("open_score") < -1).cast("double"))
    body = ((F.col("n_words") >= 8) & (F.col("is_link") == 0) & (F.col("open_score") > -1)).cast("double")
    return b.select(
        "page_id", "element_id", "ord", "text", "n_words", "is_link", "tag_class", "ends",
        F.coalesce("known_x", F.lit(UNKNOWN_X)).alias("x"),
        F.coalesce(F.last("known_x", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(UNKNOWN_X)).alias("prev_x"),
        F.coalesce(F.first("known_x", True).over(w.rowsBetween(1, 3)), F.lit(UNKNOWN_X)).alias("next_x"),
        "open_score", at("open_score", 1).alias("open_prev"), at("open_score", -1).alias("open_next"),
        at("n_words", 1).alias("words_prev"), at("n_words", -1).alias("words_next"), at("n_words", 2).alias("words_prev2"), at("n_words", -2).alias("words_next2"),
        near("is_link", 2).alias("links_2"), near("is_link", 5).alias("links_5"),
        "after_title", F.sum("after_title").over(before).alias("since_title"),
        F.sum(F.col("boiler") * F.col("after_title")).over(before).alias("boiler_before"),
        F.coalesce(F.sum("boiler").over(w.rowsBetween(1, 3)), F.lit(0.0)).alias("boiler_next"),
        F.coalesce(F.sum(body).over(after), F.lit(0.0)).alias("body_after"),
    )


def labelled() -> pd.DataFrame:
    """The labelled table: blocks of some pages with what concerns the block alone, and whether it is main body."""
    with files("veilmark.llm").joinpath("data/labelled_blocks.tsv").open("rb") as f:
        return pd.read_csv(f, sep="\t", keep_default_na=False, na_values={"known_x": [""]}, quoting=3)


def opening_scores(rows: pd.DataFrame, smooth: float = 1.0, least: int = 2) -> dict[str, float]:
    """Log-odds of main body by opening words; openings seen on fewer than `least` pages say nothing."""
    pages = rows.groupby("opening").page_id.nunique()
    total = rows.groupby("opening").y.agg(["sum", "count"])
    base = math.log((rows.y.sum() + smooth) / (len(rows) - rows.y.sum() + smooth))
    out = {}
    for opening, (pos, n) in zip(total.index, total.to_numpy(), strict=True):
        if opening and pages[opening] >= least:
            out[opening] = float(np.clip(math.log((pos + smooth) / (n - pos + smooth)) - base, -4, 4))
    return out


def local_features(rows: pd.DataFrame, scores: dict[str, float]) -> np.ndarray:
    """The features of `featured` over the labelled table, by the same definitions."""
    out = []
    for _, g in rows.groupby("page_id", sort=False):
        n = len(g)
        score = g.opening.map(scores).fillna(0.0).to_numpy(float)
        words, link, x = g.n_words.to_numpy(float), g.is_link.to_numpy(float), g.known_x.to_numpy(float)
        after = np.maximum.accumulate(g.is_title.to_numpy(float))
        boiler = (score < -1).astype(float)
        body = ((words >= 8) & (link == 0) & (score > -1)).astype(float)
        shift = lambda v, k: np.concatenate([np.zeros(min(k, n)), v[: n - k]]) if k > 0 else np.concatenate([v[-k:], np.zeros(min(-k, n))])
        near = lambda v, k: np.array([v[max(0, i - k) : i + k + 1].mean() for i in range(n)])
        prev_x, next_x, last = np.full(n, UNKNOWN_X), np.full(n, UNKNOWN_X), UNKNOWN_X
        for i in range(n):
            prev_x[i] = last
            if x[i] == x[i]:
                last = x[i]
            ahead = [v for v in x[i + 1 : i + 4] if v == v]
            next_x[i] = ahead[0] if ahead else UNKNOWN_X
        ahead3 = np.array([boiler[i + 1 : i + 4].sum() for i in range(n)])
        out.append(
            np.column_stack(
                [
                    words, link, g.tag_class, g.ends, np.where(np.isnan(x), UNKNOWN_X, x), prev_x, next_x, score, shift(score, 1), shift(score, -1), shift(words, 1), shift(words, -1), shift(words, 2), shift(words, -2),
                    near(link, 2), near(link, 5), after, np.cumsum(after), np.cumsum(boiler * after), ahead3, body.sum() - np.cumsum(body),
                ]
            )
        )
    return np.vstack(out)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> dict:
    """A CART tree by Gini impurity: {"p": share} or {"f": feature, "at": threshold, "le": tree, "gt": tree}."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return {"p": p}
    best = (2 * p * (1 - p) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, pos = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero(v[:-1] < v[1:])
        cut = cut[(n[cut] >= least) & (len(y) - n[cut] >= least)]
        if not len(cut):
            continue
        nl, pl = n[cut], pos[cut]
        nr, pr = len(y) - nl, pos[-1] - pl
        gini = 2 * pl * (nl - pl) / nl + 2 * pr * (nr - pr) / nr
        i = int(np.argmin(gini))
        if gini[i] < best[0]:
            best = (float(gini[i]), f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best[1] is None:
        return {"p": p}
    left = x[:, best[1]] <= best[2]
    return {"f": best[1], "at": best[2], "le": grow(x[left], y[left], depth - 1, least), "gt": grow(x[~left], y[~left], depth - 1, least)}


def as_column(tree: dict, names: tuple[str, ...] = FEATURES) -> Column:
    if "p" in tree:
        return F.lit(tree["p"])
    return F.when(F.col(names[tree["f"]]) <= tree["at"], as_column(tree["le"], names)).otherwise(as_column(tree["gt"], names))


@lru_cache(maxsize=4)
def model(depth: int = 9, least: int = 4) -> tuple[dict[str, float], dict]:
    rows = labelled()
    scores = opening_scores(rows)
    return scores, grow(local_features(rows, scores), rows.y.to_numpy(float), depth, least)


def scored(spark: SparkSession, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """All blocks of the given pages with their features and `p`, the tree's share of main body."""
    scores, tree = model()
    # bounded by the labelled table, whatever the input
    lexicon = spark.createDataFrame([(k, v) for k, v in scores.items()], "opening string, open_score double")
    b = blocks(elements, pages).join(F.broadcast(lexicon), "opening", "left").fillna(0.0, ["open_score"])
    return featured(b).withColumn("p", as_column(tree))


def main_body(spark: SparkSession, elements: DataFrame, pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, element_id, ord, text) of the main body, in document order by ord."""
    found = scored(spark, elements, pages)
    return found.filter((F.col("p") >= threshold) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("page_id", "element_id", "ord", "text")
