"""Containers and mixes, on sizes with brute force beside them."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmark.llm import mixing, packing, tokens


def check(ids, sizes, capacity, out):
    fill, pieces = {}, {}
    for c, i, p, start, size in out:
        fill[c] = fill.get(c, 0) + size
        pieces.setdefault(i, []).append((p, start, size))
    assert all(0 < f <= capacity for f in fill.values())
    for i, s in enumerate(sizes):
        got = sorted(pieces.get(i, []))
        assert sum(x[2] for x in got) == s
        # split only above the capacity, in order, without gaps
        assert len(got) == -(-s // capacity) and [x[0] for x in got] == list(range(len(got)))
        assert all(x[1] == k * capacity for k, x in enumerate(got))
    return len(fill)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 250), max_size=60), st.integers(1, 100))
def test_every_item_is_packed(sizes, capacity):
    check(np.arange(len(sizes)), sizes, capacity, packing.pack(np.array(sizes, np.int64), capacity))


def optimum(sizes, capacity):
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, where, strict=True) if w == b) <= capacity for b in range(n)):
                return n
    return 0


@pytest.mark.parametrize("seed", range(8))
def test_near_the_optimum(seed):
    sizes = np.random.default_rng(seed).integers(1, 60, 7)
    n = check(np.arange(7.0), sizes.tolist(), 60, packing.pack(sizes, 60))
    assert n <= optimum(sizes.tolist(), 60) + 1


def test_local_search_empties_a_bin():
    sizes = np.array([6, 5, 4, 3, 2], np.int64)
    bins = packing._Bins(10)
    bins.items, bins.fill = [[0, 3], [1, 2], [4]], [9, 9, 2]
    packing._improve(bins, sizes.tolist(), 2)
    assert sorted(f for f in bins.fill if f) == [10, 10] and sorted(sum(bins.items, [])) == [0, 1, 2, 3, 4]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=2, max_size=12), st.integers(30, 60))
def test_steps_raise_the_squares(sizes, capacity):
    half = len(sizes) // 2
    bins = packing._Bins(capacity)
    bins.items = [list(range(half)), list(range(half, len(sizes)))]
    bins.fill = [sum(sizes[k] for k in x) for x in bins.items]
    if max(bins.fill) > capacity:
        return
    donor = 0 if bins.fill[0] < bins.fill[1] else 1
    before = sum(f * f for f in bins.fill)
    search = packing._Search(bins, sizes)
    step = search.best(donor)
    # the best step by trying all of them
    b, free = 1 - donor, capacity - bins.fill[1 - donor]
    give, take = [sizes[k] for k in bins.items[donor]], [sizes[k] for k in bins.items[b]]
    given = give + [x + y for i, x in enumerate(give) for y in give[i + 1 :]]
    gains = [d for d in [*give, *(g - t for g in given for t in take)] if 0 < d <= free] if free and 0 < bins.fill[donor] else []
    assert (step[0] if step else 0) == max(gains, default=0)
    if step:
        search.apply(donor, step)
        assert sum(f * f for f in bins.fill) > before and max(bins.fill) <= capacity
        assert bins.fill == [sum(sizes[k] for k in x) for x in bins.items] and sorted(sum(bins.items, [])) == list(range(len(sizes)))


def test_large_containers_are_searched_too():
    """More than 64 items a container: exchanges still close the last gaps."""
    r = np.random.default_rng(3)
    sizes = np.concatenate([r.integers(20, 60, 900), r.integers(400, 900, 60)])
    out = packing.pack(sizes, 8192)
    n = check(np.arange(len(sizes)), sizes.tolist(), 8192, out)
    assert n == -(-int(sizes.sum()) // 8192)


def test_containers(spark):
    rows = [(i, int(s), "x") for i, s in enumerate(np.random.default_rng(0).integers(0, 900, 3000))] + [(None, 5, "x"), (7, 9, "x"), (8, None, "x")]
    items = spark.createDataFrame(rows, "item_id long, size int, capacity string")
    targets = spark.createDataFrame([(1, 512), (2, 1024)], "target_id int, capacity int")
    out = packing.packed(items, targets, shard_items=1000).toPandas()
    for t, cap in ((1, 512), (2, 1024)):
        mine = out[out.target_id == t]
        assert mine["size"].sum() == sum(r[1] or 0 for r in rows)
        fill = mine.groupby("container_id")["size"].sum()
        assert fill.max() <= cap and fill.sum() / (len(fill) * cap) > 0.98
    assert packing.packed(items.limit(0), targets).count() == 0
    report = packing.fill_report(packing.packed(items, targets)).collect()
    assert all(r["n_containers"] >= r["lower_bound"] for r in report)


T = "source string, target_share double, max_repeats int"


def docs(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(4000)] + [(10_000 + i, "small", 11) for i in range(40)] + [(20_000 + i, "zero", 5) for i in range(10)] + [(30_000, None, 5), (30_001, "other", 5), (30_002, "big", None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, n_tokens int, place string")


def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("zero", 0.0, 2), ("none", 0.2, 2)], T)


def test_shares(spark):
    got = {r["source"]: r for r in mixing.shares(docs(spark), targets(spark), size=40_000).collect()}
    assert abs(got["big"]["tokens"] - 20_000) <= 16 and not got["big"]["short"] and got["big"]["most_copies"] == 1
    assert got["small"]["tokens"] == 3 * 440 and got["small"]["short"] and got["small"]["most_copies"] == 3
    assert got["zero"]["tokens"] == 0 and not got["zero"]["short"]
    assert got["none"]["tokens"] == 0 and got["none"]["short"]
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9


def test_larger_mixes_contain_smaller_ones(spark):
    a, b = ({r["doc_id"] for r in mixing.mixed(docs(spark), targets(spark), size=n)[0].filter("source = 'big'").collect()} for n in (10_000, 30_000))
    assert a < b


def test_partial_repeats(spark):
    taken, plans = mixing.mixed(docs(spark), spark.createDataFrame([("small", 1.0, 3)], T), size=700)
    rows = taken.collect()
    assert {r["n_copies"] for r in rows} == {1, 2} and abs(sum(r["n_copies"] * r["n_tokens"] for r in rows) - 700) <= 11
    assert (plans[0].passes, plans[0].rest) == (1, 260)


def test_empty(spark):
    got = mixing.shares(docs(spark).limit(0), targets(spark)).collect()
    assert len(got) == 4 and all(r["tokens"] == 0 and r["actual_share"] == 0 for r in got)


def test_token_counts(spark):
    import os

    if not os.path.exists(tokens.TOKENIZER):
        pytest.skip("no tokenizer files")
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("a" * 10_000,)], "t string").select(tokens.n_tokens(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got][:3] == [2, 0, None] and got[3]["n"] > 1 and got[4]["n"] > 100
