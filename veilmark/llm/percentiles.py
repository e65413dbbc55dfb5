"""Percentiles of large numeric columns by deterministic, mergeable rank-interval summaries.

A summary is a sorted list of tuples (value, rmin, rmax): the value's rank in the data lies between rmin and rmax. A
partition keeps one summary a group and measure: values are buffered, sorted exactly and compressed, dropping every
tuple whose neighbours stay within the permitted uncertainty, rmax(next) - rmin(previous) <= 2 * error * n. Summaries of
partitions are merged in two levels (by bucket of partitions, then by group); ranks of a merged tuple are the sums
of the neighbours' ranks, so the accumulated error is known from the tuples themselves and is reported. Each level may
use a further third of the permitted error: a third in the partition, two thirds after the first merge, all of it at
the end. Any percentile is then answered within error * n ranks, and summaries of days or partitions combine into those
of the whole under the same bound.

Nothing but summaries (at most about 3 / (2 * error) tuples a group, and never more than its values) is shuffled, so
a hot group costs no more than any other.

Defined cases: null and NaN readings and, as durations, negative ones are left out (counted as n_invalid); infinities
are values; a null group is a group; ties share their rank interval; a group without valid readings has null
percentiles and n = 0; identical deliveries are dropped by key before; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = 0.002
#: Readings a task holds before all of its groups are summarised, and groups (by measure) before they are handed on.
WAITING, GROUPS = 1 << 22, 4096
BUFFER = 1 << 16


class Summary:
    """Sorted values with the bounds of their ranks (1-based)."""

    __slots__ = ("n", "v", "lo", "hi")

    def __init__(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int):
        self.v, self.lo, self.hi, self.n = v, lo, hi, n

    @classmethod
    def of(cls, values: np.ndarray) -> Summary:
        v = np.sort(values)
        ranks = np.arange(1, len(v) + 1, dtype=np.int64)
        return cls(v, ranks, ranks, len(v))

    def merge(self, other: Summary) -> Summary:
        if not self.n:
            return other
        if not other.n:
            return self
        parts = []
        for a, b, side in ((self, other, "left"), (other, self, "right")):
            # ties: values of self come before equal ones of other
            k = np.searchsorted(b.v, a.v, side=side)
            below = np.where(k > 0, b.lo[np.maximum(k - 1, 0)], 0)
            above = np.where(k < len(b.v), b.hi[np.minimum(k, len(b.v) - 1)] - 1, b.n)
            parts.append((a.v, a.lo + below, a.hi + above))
        v = np.concatenate([p[0] for p in parts])
        lo = np.concatenate([p[1] for p in parts])
        hi = np.concatenate([p[2] for p in parts])
        order = np.lexsort((hi, lo, v))
        return Summary(v[order], lo[order], hi[order], self.n + other.n)

    def compress(self, error: float) -> Summary:
        """Drops tuples between kept ones no further than 2 * error * n ranks apart; the ends stay."""
        room = int(2 * error * self.n)
        m = len(self.v)
        if m <= 2 or room < 2:
            return self
        reach = np.maximum.accumulate(self.hi)
        keep = [0]
        while keep[-1] < m - 1:
            i = keep[-1]
            j = int(np.searchsorted(reach, self.lo[i] + room, side="right")) - 1
            keep.append(min(max(j, i + 1), m - 1))
        return Summary(self.v[keep], self.lo[keep], self.hi[keep], self.n)

    def quantile(self, q: float) -> tuple[float, int]:
        """(value, bound of its rank's distance to the rank asked for)."""
        rank = min(max(int(np.ceil(q * self.n)), 1), self.n)
        off = np.maximum(rank - self.lo, self.hi - rank)
        i = int(off.argmin())
        return float(self.v[i]), int(max(off[i], 0))


def merged(parts: Sequence[Summary], error: float) -> Summary:
    """A balanced merge of any number of summaries, compressed once at the end."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [parts[i].merge(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].compress(error)


class _Gatherer:
    """Summary of a stream: full buffers are summarised, summaries of equal level merged like binary digits.

    Compression goes by what is permitted at the end of a stream of any length: buffers use half of the leaf error, the
    merged digits the rest, once each, when they are put together.
    """

    def __init__(self, error: float):
        self.error, self.buffer, self.held, self.digits = error, [], 0, []

    def add(self, values: np.ndarray) -> None:
        self.buffer.append(values)
        self.held += len(values)
        if self.held >= BUFFER:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.digits.append(Summary.of(np.concatenate(self.buffer)).compress(self.error / 2))
            self.buffer, self.held = [], 0
            if len(self.digits) >= 64:
                # merging adds no relative error; nothing is compressed a second time here
                self.digits = [merged(self.digits, 0.0)] if sum(len(d.v) for d in self.digits) < 1 << 20 else [merged(self.digits, self.error / 2)]

    def end(self) -> Summary:
        self.flush()
        return merged(self.digits, self.error)


def _schema(groups: T.StructType, extra: str = "bucket int") -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in groups] + [extra, "measure string, n long, n_invalid long, v array<double>, lo array<long>, hi array<long>"])


def _row(key: tuple, names: Sequence[str], bucket: int, measure: str, s: Summary, invalid: int) -> dict:
    return dict(zip(names, key, strict=True)) | {"bucket": bucket, "measure": measure, "n": s.n, "n_invalid": invalid, "v": s.v, "lo": s.lo, "hi": s.hi}


EMPTY = Summary(np.array([]), np.array([], dtype=np.int64), np.array([], dtype=np.int64), 0)


def summaries(df: DataFrame, groups: Sequence[str], measures: Sequence[str], error: float = ERROR, buckets: int = 64) -> DataFrame:
    """One summary a group and measure: (groups, measure, n, n_invalid, v, lo, hi)."""
    src = df.select(*groups, *[F.col(m).cast("double").alias(m) for m in measures])
    fields = T.StructType([src.schema[g] for g in groups])
    schema, names = _schema(fields), list(groups)
    leaf, middle = error / 3, 2 * error / 3

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId() % buckets
        held: dict = {}
        waiting = 0

        def rows() -> Iterator[pd.DataFrame]:
            out = []
            for (key, m), (gatherer, invalid) in held.items():
                gatherer.flush()
                out.append(_row(key, names, bucket, m, gatherer.end() if gatherer.digits else EMPTY, invalid))
                if len(out) >= 256:
                    yield pd.DataFrame(out)
                    out = []
            if out:
                yield pd.DataFrame(out)
            held.clear()

        for batch in batches:
            for key, g in batch.groupby(names, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                for m in measures:
                    x = g[m].to_numpy(np.float64)
                    ok = x[~np.isnan(x) & (x >= 0)]
                    entry = held.setdefault((key, m), [_Gatherer(leaf), 0])
                    entry[1] += len(x) - len(ok)
                    if len(ok):
                        entry[0].add(ok)
                        waiting += len(ok)
            # a task holds a bounded number of readings and of groups, however many there are
            if waiting > WAITING:
                for gatherer, _ in held.values():
                    gatherer.flush()
                waiting = 0
            if len(held) > GROUPS:
                yield from rows()
                waiting = 0
        yield from rows()

    level = src.mapInPandas(build, schema)
    return _combine(_combine(level, names, fields, middle, True), names, fields, 0.0, False).drop("bucket")


def _combine(df: DataFrame, names: Sequence[str], fields: T.StructType, error: float, by_bucket: bool) -> DataFrame:
    keys = [*names, "measure"] + (["bucket"] if by_bucket else [])

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a group are adjacent: one group's summaries are held at a time, and no frame is built for each
        current, parts, invalid, rows = None, [], 0, []
        for batch in batches:
            key_columns = [batch[k] for k in keys]
            for at, v, lo, hi, n, bad in zip(zip(*key_columns, strict=True), batch.v, batch.lo, batch.hi, batch.n, batch.n_invalid, strict=True):
                key = tuple(None if pd.isna(k) else k for k in at)
                if key != current:
                    if parts:
                        rows.append(closed(current, parts, invalid))
                        if len(rows) >= 256:
                            yield pd.DataFrame(rows)
                            rows = []
                    current, parts, invalid = key, [], 0
                parts.append(Summary(np.asarray(v, float), np.asarray(lo, np.int64), np.asarray(hi, np.int64), int(n)))
                invalid += int(bad)
                if len(parts) >= 64:
                    parts = [merged(parts, 0.0)]
        if parts:
            rows.append(closed(current, parts, invalid))
        if rows:
            yield pd.DataFrame(rows)

    def closed(key: tuple, parts: list, invalid: int) -> dict:
        return _row(key[: len(names)], names, int(key[-1]) if by_bucket else 0, key[len(names)], merged(parts, error), invalid)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(flow, _schema(fields))


def combined(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Summaries of parts (days, partitions, tables) merged into those of `groups`."""
    fields = T.StructType([parts.schema[g] for g in groups])
    spread = parts.withColumn("bucket", F.pmod(F.xxhash64(*[c for c in parts.columns if c not in ("v", "lo", "hi")]), F.lit(64)).cast("int"))
    kept = spread.select(*groups, "bucket", "measure", "n", "n_invalid", "v", "lo", "hi")
    return _combine(_combine(kept, list(groups), fields, 0.0, True), list(groups), fields, 0.0, False).drop("bucket")


def quantiles(found: DataFrame, groups: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """(groups, measure, q, value, n, n_invalid, rank_error): rank_error bounds the distance in ranks."""
    fields = T.StructType([found.schema[g] for g in groups])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["measure string, q double, value double, n long, n_invalid long, rank_error long"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                s = Summary(np.asarray(r.v, float), np.asarray(r.lo, np.int64), np.asarray(r.hi, np.int64), int(r.n))
                for q in qs:
                    value, off = s.quantile(q) if s.n else (None, None)
                    rows.append({**{g: getattr(r, g) for g in groups}, "measure": r.measure, "q": q, "value": value, "n": s.n, "n_invalid": int(r.n_invalid), "rank_error": off})
            yield pd.DataFrame(rows, columns=[*groups, "measure", "q", "value", "n", "n_invalid", "rank_error"]).astype({"rank_error": "Int64"})

    return found.select(*groups, "measure", "n", "n_invalid", "v", "lo", "hi").mapInPandas(ask, schema)
