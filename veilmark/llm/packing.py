"""Items of varying size into containers of fixed capacity, with little space unused.

Items are spread over shards by a hash of their id. A shard is packed by best fit in order of falling size and then
improved by local search: between underfull containers an item is moved, or exchanged one for one or two for one,
whenever that raises the sum of squared fills; a container that runs empty is gone. The search ends at the lower bound
(total size over capacity, rounded up) or when no step helps, whatever the number of items in a container. Shards have about `shard_items` items whatever the size
of the input, so a task's work is bounded, and the space a shard can lose by being packed alone is at most one
container in thousands. Only ids and sizes are shuffled; texts never leave their partition.

An item larger than the capacity is cut into full containers and a rest; nothing else is ever split.

Defined cases: null and empty items have size 0 and get no container (they are not in the result); a null id is an
item like any other; repeated ids are packed once each row; equal sizes are ordered by id, so results are the same in
every run; capacities must be positive; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "target_id int, capacity int, container_id string, item_id long, piece int, start int, size int"


class _Bins:
    """Containers by free space, for best fit."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.free: list[int] = []

    def add(self, size: int, item: int) -> None:
        i = bisect_left(self.free, size)
        if i < len(self.free):
            free = self.free[i]
            stack = self.at[free]
            b = heapq.heappop(stack)
            if not stack:
                del self.at[free]
                self.free.pop(i)
        else:
            b, free = len(self.items), self.capacity
            self.items.append([])
            self.fill.append(0)
        self.items[b].append(item)
        self.fill[b] += size
        left = free - size
        if left:
            if left not in self.at:
                self.at[left] = []
                insort(self.free, left)
            heapq.heappush(self.at[left], b)


#: Free space up to which exchanges are looked up by the size of the item that would come back.
NARROW = 64


class _Search:
    """Local search between underfull containers, by indexes that are kept up to date.

    A step moves an item of the donor to a container that is at least as full, or exchanges it, or two of them, for a
    smaller one of that container; every step raises the sum of squared fills. Receivers are found by their free space
    (moves), by the sizes of their items (exchanges into little free space) and one by one (into much, which few have),
    so no pair of containers is tried without cause and no container is left out.
    """

    def __init__(self, bins: _Bins, sizes: list[int]):
        self.capacity, self.items, self.fill, self.sizes = bins.capacity, bins.items, bins.fill, sizes
        self.by_size: dict[int, set[int]] = {}
        self.by_free: list[tuple[int, int]] = []
        for b in range(len(self.items)):
            self._list(b)

    def _list(self, b: int) -> None:
        if 0 < self.fill[b] < self.capacity:
            insort(self.by_free, (self.capacity - self.fill[b], b))
            for k in self.items[b]:
                self.by_size.setdefault(self.sizes[k], set()).add(b)

    def _unlist(self, b: int) -> None:
        if 0 < self.fill[b] < self.capacity:
            self.by_free.pop(bisect_left(self.by_free, (self.capacity - self.fill[b], b)))
            for size in {self.sizes[k] for k in self.items[b]}:
                holders = self.by_size[size]
                holders.discard(b)
                if not holders:
                    del self.by_size[size]

    def best(self, donor: int) -> tuple[int, int, list[int], list[int]] | None:
        """(gain, receiver, items given, items taken) of the step that fills a receiver most; the first of equal ones."""
        fill, capacity, sizes = self.fill, self.capacity, self.sizes
        give = {}
        for k in self.items[donor]:
            give.setdefault(sizes[k], [k])
        found: tuple | None = None
        gain = 0
        for size in sorted(give, reverse=True):
            for free, b in self.by_free[bisect_left(self.by_free, (size, -1)) :]:
                if b != donor and fill[b] >= fill[donor]:
                    found, gain = (size, b, give[size], []), size
                    break
            if found:
                break
        one = self.items[donor]
        given = {s: k for s, k in give.items()}
        for i, x in enumerate(one):
            for y in one[i + 1 :]:
                given.setdefault(sizes[x] + sizes[y], [x, y])
        most = self.by_free[-1][0] if self.by_free else 0
        wide = [(free, b) for free, b in self.by_free[bisect_left(self.by_free, (NARROW + 1, -1)) :] if b != donor and fill[b] >= fill[donor]]
        for total in sorted(given, reverse=True):
            if most <= gain:
                break
            for free, b in reversed(wide):
                if free <= gain:
                    break
                for k in self.items[b]:
                    d = total - sizes[k]
                    if gain < d <= free:
                        found, gain = (d, b, given[total], [k]), d
            for d in range(min(NARROW, most, total - 1), gain, -1):
                holders = self.by_size.get(total - d)
                b = min((b for b in holders if capacity - fill[b] >= d and b != donor and fill[b] >= fill[donor]), default=None) if holders else None
                if b is not None:
                    found, gain = (d, b, given[total], [next(k for k in self.items[b] if sizes[k] == total - d)]), d
                    break
        return found

    def apply(self, donor: int, step: tuple[int, int, list[int], list[int]]) -> None:
        gain, b, give, take = step
        self._unlist(donor)
        self._unlist(b)
        for k in give:
            self.items[donor].remove(k)
            self.items[b].append(k)
        for k in take:
            self.items[b].remove(k)
            self.items[donor].append(k)
        self.fill[b] += gain
        self.fill[donor] -= gain
        self._list(donor)
        self._list(b)


def _improve(bins: _Bins, sizes: list[int], lower: int) -> None:
    """Local search until no step helps, or the number of containers is the lower bound."""
    search = _Search(bins, sizes)
    fill = bins.fill
    used = sum(1 for f in fill if f)
    changed = True
    while changed:
        # an exchange between two full containers may open room for the emptiest one: passes repeat until none helps
        changed = False
        for donor in sorted((b for b in range(len(fill)) if 0 < fill[b] < bins.capacity), key=lambda b: (fill[b], b)):
            if used <= lower:
                return
            while 0 < fill[donor] < bins.capacity and (step := search.best(donor)):
                search.apply(donor, step)
                changed = True
            used -= not fill[donor]


def pack(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(container, item index, piece, start, size) of one shard; equal sizes are taken in their order."""
    out = []
    container = 0
    rest: list[int] = []
    start: list[int] = []
    piece: list[int] = []
    index: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        full, left = divmod(size, capacity)
        for k in range(full):
            out.append((container, i, k, k * capacity, capacity))
            container += 1
        if left:
            rest.append(left)
            piece.append(full)
            start.append(full * capacity)
            index.append(i)
    left_sizes = np.array(rest, dtype=np.int64)
    bins = _Bins(capacity)
    for k in np.argsort(-left_sizes, kind="stable").tolist():
        bins.add(rest[k], k)
    _improve(bins, rest, -(-int(left_sizes.sum()) // capacity))
    for members in bins.items:
        if members:
            out.extend((container, index[k], piece[k], start[k], rest[k]) for k in members)
            container += 1
    return out


def packed(items: DataFrame, targets: DataFrame, shard_items: int = 8192) -> DataFrame:
    """Rows of SCHEMA: every item with its container, for each target.

    items: (item_id, size); targets: (target_id, capacity), a small fixed table.
    """
    # the count reads no sizes; the targets are a fixed table of a few rows
    shards = max(1, -(-items.count() // shard_items))
    wanted = [F.struct(F.lit(int(r["target_id"])).cast("int").alias("target_id"), F.lit(int(r["capacity"])).cast("int").alias("capacity")) for r in targets.select("target_id", "capacity").collect()]
    if not wanted:
        return items.sparkSession.createDataFrame([], SCHEMA)
    shard = F.pmod(F.xxhash64("item_id", F.lit(17)), F.lit(shards))
    rows = items.filter(F.col("size") > 0).select("item_id", "size", shard.alias("shard"), F.explode(F.array(*wanted)).alias("t")).select("item_id", "size", "shard", "t.target_id", "t.capacity")

    def one(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        target, capacity, number = int(key[0]), int(key[1]), int(key[2])
        shard = shard.sort_values(["item_id", "size"], kind="stable")
        found = pack(shard["size"].to_numpy(np.int64), capacity)
        c, i, p, s, z = (np.array(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"target_id": target, "capacity": capacity, "container_id": [f"{target}-{number}-{x}" for x in c], "item_id": shard["item_id"].iloc[i].array, "piece": p, "start": s, "size": z})

    # a group is much work on few bytes: partitions are told by number, or they would be merged by their size
    groups = shards * len(wanted)
    partitions = min(groups, max(4 * items.sparkSession.sparkContext.defaultParallelism, groups // 16))
    return rows.repartition(partitions, "target_id", "capacity", "shard").groupBy("target_id", "capacity", "shard").applyInPandas(one, SCHEMA)


def fill_report(assigned: DataFrame) -> DataFrame:
    """Containers, fill and lower bound of each target."""
    bins = assigned.groupBy("target_id", "capacity", "container_id").agg(F.sum("size").alias("fill"))
    total = bins.groupBy("target_id", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("fill").alias("total_size"), F.max("fill").alias("max_fill"))
    return total.withColumn("lower_bound", F.ceil(F.col("total_size") / F.col("capacity"))).withColumn("fill_ratio", F.round(F.col("total_size") / (F.col("n_containers") * F.col("capacity")), 6))
