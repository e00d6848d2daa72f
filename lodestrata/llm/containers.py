"""Filling fixed-capacity containers with items (problem 8): pattern packing by non-negative least squares.

The histogram of the items' sizes (at most ``capacity`` rows) is all that reaches the driver. Patterns of up to three
sizes that fill a container exactly are enumerated; how often each is used is fitted to the histogram by non-negative
least squares (projected gradient), rounded down so that no size is used more often than it occurs, and what is left is
packed best-fit, largest first, by counts rather than items. Items above the capacity give full containers and a rest
that is packed like an item; no other item is split.

The plan (a few thousand patterns, whatever the number of items) goes back to the tasks as intervals of ranks: the k-th
item of a size belongs to the pattern whose interval holds k. Ranks are counted in hash buckets of a size and added up,
so a size that a third of all items share is ranked by many tasks.

Defined results: null sizes and sizes below 1 are left out; ties are ranked by id; repeated ids are items of their own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
THIRDS = 48
ITEMS_A_BUCKET = 50_000


def patterns(counts: np.ndarray, capacity: int, thirds: int = THIRDS) -> np.ndarray:
    """Rows of three sizes (0: none) that fill a container exactly: all pairs, and triples with one of the most frequent sizes."""
    sizes = np.flatnonzero(counts)
    have = counts > 0
    rows = [np.array([[capacity, 0, 0]])] if capacity < len(have) and have[capacity] else []
    a = sizes[(sizes * 2 >= capacity) & (sizes < capacity)]
    a = a[have[capacity - a]]
    rows.append(np.stack([a, capacity - a, 0 * a], 1))
    for c in sizes[np.argsort(-counts[sizes], kind="stable")][:thirds]:
        left = capacity - c
        a = sizes[(sizes * 2 >= left) & (sizes < left)]
        a = a[have[left - a]]
        rows.append(np.stack([a, left - a, 0 * a + c], 1))
    out = np.concatenate(rows)
    return np.unique(np.sort(out, 1)[:, ::-1], axis=0) if len(out) else out.reshape(0, 3)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts x with least |A x - counts|, A the sizes in each pattern."""
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    used = rows > 0
    target = counts.astype(np.float64)
    degree = np.bincount(rows[used], minlength=len(counts)).astype(np.float64)
    rate = 1.0 / np.maximum(1.0, (degree[rows] * used).sum(1))  # below 1 / |A'A| row by row
    y, momentum = x.copy(), 1.0
    for _ in range(steps):
        made = np.zeros(len(counts))
        for k in range(3):
            made += np.bincount(rows[:, k], weights=y, minlength=len(counts))
        miss = target - made
        miss[0] = 0
        new = np.maximum(0, y + rate * (miss[rows] * used).sum(1))
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y, x, momentum = new + (momentum - 1) / after * (new - x), new, after
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(sizes with their numbers, times) of the containers' patterns; every item of the histogram is in one."""
    left = counts.astype(np.int64).copy()
    rows = patterns(left, capacity)
    x = fit(rows, left)
    groups: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-x, kind="stable"):
        times = int(x[k] + 0.5)
        if times < 1:
            break
        need: dict[int, int] = defaultdict(int)
        for s in rows[k]:
            if s:
                need[int(s)] += 1
        times = min(times, *(int(left[s]) // m for s, m in need.items()))
        if times > 0:
            groups.append((dict(need), times))
            for s, m in need.items():
                left[s] -= m * times
    return groups + best_fit(left, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """What is left, largest first into the fullest container that still has room, many equal ones at a time."""
    open_: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]  # by free space
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        free = size
        while n:
            while free <= capacity and not open_[free]:
                free += 1
            if free > capacity:
                each = capacity // size
                times = n // each
                if times:
                    open_[capacity - each * size].append(({size: each}, times))
                    n -= each * times
                if n:
                    open_[capacity - n * size].append(({size: n}, 1))
                break
            need, times = open_[free].pop()
            each = min(free // size, n)
            use = min(times, n // each)
            if use < times:
                open_[free].append((need, times - use))
            open_[free - each * size].append(({**need, size: each}, use))
            n -= each * use
            free = size
    return [g for row in open_ for g in row]


def intervals(groups: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: where the ranks of each pattern begin, its items a container, and its first container."""
    begin: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for need, times in groups:
        for s, m in need.items():
            begin[s].append((taken[s], m, first))
            taken[s] += m * times
        first += times
    return {s: tuple(np.asarray(c, np.int64) for c in zip(*rows)) for s, rows in begin.items()}


def _assign(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            out = np.empty(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                starts, each, first = table[int(s)]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                out[at] = first[k] + (rank[at] - starts[k]) // each[k]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("size"), pa.array(out)], names=["id", "part", "size", "container"])

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, size, container): every item, or part of an item above the capacity, with its container."""
    spark, kind = items.sparkSession, items.schema[key].dataType.simpleString()
    sized = items.select(F.col(key).alias("id"), F.col(size).cast("bigint").alias("whole")).where("whole > 0")
    full = F.expr(f"cast(whole div {capacity} as int)")
    parts = F.when(F.col("whole") <= capacity, F.array(F.col("whole"))).otherwise(
        F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), full), F.when(F.col("whole") % capacity > 0, F.array(F.col("whole") % capacity)).otherwise(F.array().cast("array<bigint>")))
    )
    rows = cut(sized.select("id", F.posexplode(parts).alias("part", "size")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("size").count().collect():  # at most ``capacity`` rows
        counts[r["size"]] = r["count"]
    held = spark.sparkContext.broadcast(intervals(plan(counts, capacity)))
    buckets = int(max(1, counts.max() // ITEMS_A_BUCKET + 1))
    split = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).cast("int"))
    from pyspark.sql import Window

    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("size", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "part")) - 1
    ranked = split.withColumn("k", inner).join(offsets, ["size", "bucket"]).select("id", "part", "size", (F.col("before") + F.col("k")).alias("rank"))
    out = ranked.mapInArrow(_assign(held), f"id {kind}, part int, size bigint, container bigint")
    return out.withColumnRenamed("id", key)
