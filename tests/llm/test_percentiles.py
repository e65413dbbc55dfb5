"""Rank-interval summaries against exact ranks."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilmark.llm import percentiles as Q


def off(values, q, got):
    v = np.sort(values)
    rank = min(max(math.ceil(q * len(v)), 1), len(v))
    return max(np.searchsorted(v, got, "left") + 1 - rank, rank - np.searchsorted(v, got, "right"), 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.floats(allow_nan=False, width=32), max_size=200), min_size=1, max_size=8), st.sampled_from([0.01, 0.05, 0.2]))
def test_merged_ranks_hold(parts, error):
    whole = np.concatenate([np.array(p, float) for p in parts])
    s = Q.merged([Q.Summary.of(np.array(p, float)).compress(error / 2) for p in parts], error)
    assert s.n == len(whole)
    if s.n:
        v = np.sort(whole)
        for x, lo, hi in zip(s.v, s.lo, s.hi, strict=True):
            # some copy of the value has a rank between the bounds
            assert np.searchsorted(v, x, "left") + 1 <= hi and np.searchsorted(v, x, "right") >= lo
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            value, bound = s.quantile(q)
            assert off(whole, q, value) <= bound <= math.ceil(error * s.n) + 1


@pytest.mark.parametrize("error", [0.001, 0.01, 0.1])
def test_size_is_bounded(error):
    s = Q.merged([Q.Summary.of(np.random.default_rng(i).lognormal(0, 2, 20_000)).compress(error / 3) for i in range(12)], error)
    assert len(s.v) <= 3 / error + 3


def test_gathering_a_long_stream():
    rng = np.random.default_rng(1)
    g = Q._Gatherer(0.002)
    parts = [rng.exponential(3, 30_000) for _ in range(20)]
    for p in parts:
        g.add(p)
    s, whole = g.end(), np.concatenate(parts)
    for q in (0.01, 0.5, 0.99):
        value, bound = s.quantile(q)
        assert off(whole, q, value) <= bound <= math.ceil(0.002 * len(whole)) + 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, day int, x double, y double, n string")


def test_days_combine_into_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "b", int(i % 5), float(abs(v)), float(-1.0 if i % 11 == 0 else v * v), "clash") for i, v in enumerate(rng.standard_normal(20_000))]
    df = frame(spark, rows).repartition(16)
    exact = pd.DataFrame(rows, columns=["g", "day", "x", "y", "n"])
    whole = Q.quantiles(Q.summaries(df, ["g"], ["x", "y"]), ["g"], (0.5, 0.99)).toPandas()
    days = Q.quantiles(Q.combined(Q.summaries(df, ["g", "day"], ["x", "y"]), ["g"]), ["g"], (0.5, 0.99)).toPandas()
    for found in (whole, days):
        assert len(found) == 3 * 2 * 2
        for r in found.itertuples():
            v = exact[exact.g.isna() if pd.isna(r.g) else exact.g == r.g][r.measure].to_numpy()
            v = v[v >= 0]
            assert r.n == len(v)
            assert off(v, r.q, r.value) <= r.rank_error <= math.ceil(Q.ERROR * len(v)) + 1


def test_invalid_readings(spark):
    df = frame(spark, [("a", 1, None, float("nan"), None), ("a", 1, -1.0, None, None), ("b", 1, 5.0, float("inf"), None), ("b", 1, 5.0, 5.0, None)])
    got = {(r["g"], r["measure"]): (r["value"], r["n"], r["n_invalid"]) for r in Q.quantiles(Q.summaries(df, ["g"], ["x", "y"]), ["g"], (0.5,)).collect()}
    assert got == {("a", "x"): (None, 0, 2), ("a", "y"): (None, 0, 2), ("b", "x"): (5.0, 2, 0), ("b", "y"): (5.0, 2, 0)}


def test_empty_table(spark):
    assert Q.quantiles(Q.summaries(frame(spark, []), ["g"], ["x"]), ["g"], (0.5,)).count() == 0
