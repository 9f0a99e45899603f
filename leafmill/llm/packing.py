"""Filling containers of fixed capacity with items, by non-negative least squares on the histogram of sizes.

A driver holds only the histogram: how many items there are of each size, at
most as many numbers as the capacity. Shallow combinations of sizes that fill
a window below the capacity are enumerated; non-negative least squares finds
how often to repeat each so that together they use up the histogram; the
counts are rounded down to what the histogram has, and what is left is packed
greedily, also by size: the largest size left, then the largest that still
fits, repeated as often as the sizes allow. The plan is a list of runs, each
naming the ranks of the items of a size that go to a range of containers.

Items get their ranks within a size without a global sort: they are spread
over slots by a hash, counted by slot and size, and numbered from the sum of
the slots before, so a size that a third of all items have is numbered in
many tasks. A search for the rank among the runs gives the container.

An item above the capacity alone is divided: full pieces fill containers of
their own, the rest is an item like others.

Defined results: items without size or of size 0 take no room and are put
into container 0 of their capacity; equal sizes are told apart by the rank;
repeated keys are refused by nobody, each row is an item; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The window is this share of the capacity; sizes of most volume tried between two others; sizes tried to fill a rest.
WINDOW, FILLERS, EACH = 0.002, 3, 2
#: Least number of slots, and items in each at most about (of all limits' shares of a slot each).
SLOTS, SLOT_ITEMS = 512, 100_000
LIMITS = 1000
#: Runs that are sent to all tasks; a longer list is joined.
RUNS = 2_000_000


def nnls(columns: list[dict[int, int]], wanted: dict[int, float], weight: dict[int, float], rounds: int = 60) -> list[float]:
    """x >= 0 of least weighted squared error of the columns' sum against wanted; columns name few rows each, so each step of the cyclic coordinate descent touches those only."""
    left = dict(wanted)
    parts = [[(s, k, k * weight[s] ** 2) for s, k in c.items()] for c in columns]
    norms = [sum(k * kw for _, k, kw in p) for p in parts]
    x = [0.0] * len(columns)
    for _ in range(rounds):
        moved = 0.0
        for j, own in enumerate(parts):
            step = sum(kw * left[s] for s, _, kw in own) / norms[j]
            new = max(0.0, x[j] + step)
            step = new - x[j]
            if step:
                x[j] = new
                moved = max(moved, abs(step) / (1 + new))
                for s, k, _ in own:
                    left[s] -= k * step
        if moved < 1e-3:
            break
    return x


def combinations(sizes: np.ndarray, counts: np.ndarray, capacity: int, window: int) -> list[dict[int, int]]:
    """Multisets of at most three different sizes whose sum lies in (capacity - window, capacity]: for every size, alone or repeated, with the sizes that fill what it leaves, and with one of the FILLERS of most volume between."""
    found: dict[tuple, dict[int, int]] = {}
    fillers = [int(s) for s in sizes[np.argsort(-sizes * counts)][:FILLERS]]

    def below(rest: int, most: int) -> list[int]:
        """The largest sizes that leave less than the window of ``rest``, the most frequent first."""
        low, high = np.searchsorted(sizes, rest - window, "right"), np.searchsorted(sizes, rest, "right")
        return [int(sizes[k]) for k in low + np.argsort(-counts[low:high])[:most]]

    def add(*parts: tuple[int, int]) -> None:
        whole: dict[int, int] = {}
        for s, k in parts:
            whole[s] = whole.get(s, 0) + k
        found.setdefault(tuple(sorted(whole.items())), whole)

    for a in map(int, sizes[::-1]):
        for i in dict.fromkeys((1, 2, capacity // a)):
            rest = capacity - i * a
            if i < 1 or rest < 0:
                continue
            if rest < window:
                add((a, i))
            for b in below(rest, EACH):
                add((a, i), (b, 1))
            for b in fillers:
                for j in dict.fromkeys((1, rest // b)):
                    if j and j * b <= rest:
                        if rest - j * b < window:
                            add((a, i), (b, j))
                        for c in below(rest - j * b, 1):
                            add((a, i), (b, j), (c, 1))
    return list(found.values())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first rank, number of containers, items of the size in each, first container): containers first, first + 1, … take the next items each."""
    left = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    taken: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    containers = 1

    def repeat(parts: dict[int, int], times: int) -> None:
        nonlocal containers
        for s, k in parts.items():
            runs.append((s, taken[s], times, k, containers))
            taken[s] += times * k
            left[s] -= times * k
            if not left[s]:
                del left[s]
        containers += times

    if left:
        sizes = np.array(sorted(left))
        counts = np.array([left[s] for s in sizes], float)
        found = combinations(sizes, counts, capacity, max(1, round(WINDOW * capacity)))
        times = nnls(found, dict(left), {s: s / capacity for s in left})
        for j in sorted(range(len(found)), key=lambda j: -times[j]):
            n = min(int(times[j] + 0.5), *(left.get(s, 0) // k for s, k in found[j].items()))
            if n > 0:
                repeat(found[j], n)
    while left:
        descending = sorted(left, reverse=True)
        parts: dict[int, int] = {}
        rest = capacity
        for s in descending:
            k = min(rest // s, left[s]) if s <= rest else 0
            if k:
                parts[s] = k
                rest -= k * s
            if rest < descending[-1]:
                break
        repeat(parts, max(1, min(left[s] // k for s, k in parts.items())))
    return runs


def all_limits(limits: DataFrame, most: int = LIMITS) -> list:
    """Every row of a table of limits; a table of more than ``most`` is refused."""
    rows = limits.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} limits")
    return rows


def pack(items: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """limit_id, container, ``keys``, piece, n_tokens of ``items(*keys, n_tokens)`` for every row of ``limits(limit_id, max_tokens)``.

    ``piece`` is 0 for a whole item; the pieces of a divided one count from 1.
    The limits are read on the driver; there are a handful of them, and more than ``LIMITS`` are refused.
    """
    spark = items.sparkSession
    capacities = [(int(r.limit_id), int(r.max_tokens)) for r in all_limits(limits.select("limit_id", "max_tokens")) if r.max_tokens and r.max_tokens > 0]
    if not capacities:
        return spark.createDataFrame([], items.select(F.lit(0).alias("limit_id"), F.lit(0).cast("long").alias("container"), *keys, F.lit(0).alias("piece"), F.lit(0).alias("n_tokens")).schema)
    each_limit = F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity")) for i, c in capacities))).alias("limit")
    size = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("int")
    slots = max(SLOTS, items.count() // SLOT_ITEMS)
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")
    each = items.select(*keys, size.alias("n_tokens"), slot.alias("slot"), each_limit).select("*", "limit.*").drop("limit")
    whole = F.when(F.col("n_tokens") > F.col("capacity"), (F.col("n_tokens") / F.col("capacity")).cast("int")).otherwise(F.lit(0))
    each = each.withColumn("full", whole).withColumn("size", F.col("n_tokens") - F.col("full") * F.col("capacity"))

    sums = each.groupBy("limit_id", "slot", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("fulls"))
    before = Window.partitionBy("limit_id", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).select("limit_id", "slot", "size", "ahead")
    histogram = sums.groupBy("limit_id", "size").agg(F.sum("n").alias("n"), F.sum("fulls").alias("fulls")).collect()  # at most the sum of the capacities
    runs, starts = [], []
    for limit_id, capacity in capacities:
        own = plan({r["size"]: r.n for r in histogram if r.limit_id == limit_id}, capacity)
        runs += [(limit_id, s, first, n, k, at) for s, first, n, k, at in own]
        starts.append((limit_id, max([1, *(at + n for _, _, n, _, at in own)])))

    # Rank of an item: the items of its size in the slots before, and its place in its own slot and size.
    inside = Window.partitionBy("limit_id", "slot", "size").orderBy(*keys)
    ranked = each.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["limit_id", "slot", "size"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    placed = in_containers(ranked, runs)
    rest = placed.where("not (full > 0 and size = 0)").select("limit_id", "container", *keys, F.when(F.col("full") > 0, F.col("full") + 1).otherwise(0).alias("piece"), F.col("size").alias("n_tokens"))
    large = each.where("full > 0")
    room = Window.partitionBy("limit_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = sums.groupBy("limit_id", "slot").agg(F.sum("fulls").alias("fulls")).withColumn("ahead", F.coalesce(F.sum("fulls").over(room), F.lit(0)))
    mine = Window.partitionBy("limit_id", "slot").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    divided = (
        large.withColumn("mine", F.coalesce(F.sum("full").over(mine), F.lit(0)))
        .join(by_slot.select("limit_id", "slot", "ahead"), ["limit_id", "slot"])
        .join(F.broadcast(spark.createDataFrame(starts, "limit_id int, next long")), "limit_id")
        .withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("full"))))
        .select("limit_id", (F.col("next") + F.col("ahead") + F.col("mine") + F.col("piece") - 1).alias("container"), *keys, "piece", F.col("capacity").alias("n_tokens"))
    )
    return rest.unionByName(divided)


def in_containers(ranked: DataFrame, runs: list[tuple[int, int, int, int, int, int]], most: int = RUNS) -> DataFrame:
    """``ranked(limit_id, size, rank, …)`` with ``container``, by runs (limit_id, size, first, times, per, start) that cover every rank of every size; 0 for items of size 0.

    The runs of a size follow one another, so an item finds its own by binary
    search. No more than ``most`` runs are sent to all tasks; a longer list is
    joined on limit and size.
    """
    spark = ranked.sparkSession
    if len(runs) > most:
        table = spark.createDataFrame(runs, "limit_id int, size int, first long, times long, per int, start long")
        rows = ranked.join(table, ["limit_id", "size"], "left").where("size = 0 or (rank >= first and rank < first + times * per)")
        return rows.withColumn("container", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.expr("start + (rank - first) div per"))).drop("first", "times", "per", "start")
    ordered = np.array(sorted((i, s, first, per, start) for i, s, first, _, per, start in runs), np.int64).reshape(-1, 5)
    # Limit and size by their place among the different ones: the search is for one sorted list of (place, first).
    groups, place = np.unique(ordered[:, :2], axis=0, return_inverse=True)
    shared = spark.sparkContext.broadcast((groups, np.searchsorted(place.ravel(), np.arange(len(groups) + 1)), ordered[:, 2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, begins, own = shared.value
        group_of = {(int(i), int(s)): k for k, (i, s) in enumerate(groups)}
        for batch in batches:
            limit, size, rank = (batch.column(c).to_numpy() for c in ("limit_id", "size", "rank"))
            container = np.zeros(batch.num_rows, np.int64)
            order = np.lexsort((size, limit))
            cut = np.flatnonzero(np.diff(limit[order]) | np.diff(size[order])) + 1
            for rows in np.split(order, cut) if batch.num_rows else ():
                if size[rows[0]]:
                    k = group_of[int(limit[rows[0]]), int(size[rows[0]])]
                    mine = own[begins[k] : begins[k + 1]]
                    first, per, start = mine[np.searchsorted(mine[:, 0], rank[rows], "right") - 1].T
                    container[rows] = start + (rank[rows] - first) // per
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(container)], names=[*batch.schema.names, "container"])

    slim = ranked.withColumn("rank", F.col("rank").cast("long"))
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("container", T.LongType())]))


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """limit_id, n_containers, n_tokens, largest: how full the containers are; container 0 holds nothing."""
    per = packed.where("n_tokens > 0").groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("used"))
    return (
        per.groupBy("limit_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("largest"))
        .join(limits.select("limit_id", F.col("max_tokens").alias("capacity")), "limit_id")
        .withColumn("filled", F.round(F.col("n_tokens") / F.col("n_containers") / F.col("capacity"), 4))
    )
