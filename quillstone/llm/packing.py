"""Filling containers of fixed capacity by bin completion.

Items are spread by a hash over groups of bounded size, which are packed independently; each
group wastes less than one container more than the whole would. In a group, best-fit decreasing
gives the first incumbent. If it needs more containers than the lower bound, a branch-and-bound
search completes one container at a time around the largest item left: it enumerates the fillings
that no other dominates, of any number of items, least waste first, and abandons a branch once its
waste rules out a better packing. Every complete packing that is better becomes the incumbent.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import materialize, tasks

GROUP_ITEMS = 2048
EFFORT = 100  # choices of the search, times the containers of the first incumbent
FINEST = 1 << 16  # units that a capacity is measured in while fillings are enumerated


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The containers that any packing needs: by total size, and by items that can't share one."""
    best = math.ceil(sum(sizes) / capacity)
    ascending = sorted(sizes)
    total = np.concatenate([[0], np.cumsum(ascending)])
    half = bisect.bisect_right(ascending, capacity // 2)
    for k in sorted({x for x in ascending[:half]})[:64] + [0]:
        # items over capacity - k stand alone; those over half need one each, with the room they leave
        alone = len(ascending) - bisect.bisect_right(ascending, capacity - k)
        a, b = bisect.bisect_right(ascending, capacity // 2), len(ascending) - alone
        low = bisect.bisect_left(ascending, max(k, 1))
        middle, room = b - a, (b - a) * capacity - int(total[b] - total[a])
        small = int(total[a] - total[low]) if low < a else 0
        best = max(best, alone + middle + max(0, math.ceil((small - room) / capacity)))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # ascending (room, bin)
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, (s, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
            bins[b].append(s)
            bisect.insort(rooms, (room - s, b))
        else:
            bins.append([s])
            bisect.insort(rooms, (capacity - s, len(bins) - 1))
    return bins


class _Stock:
    """The items not placed yet: distinct sizes, ascending, and how many there are of each."""

    def __init__(self, sizes: list[int]) -> None:
        self.count = Counter(sizes)
        self.values = sorted(self.count)

    def take(self, filling: tuple[int, ...]) -> None:
        for x in filling:
            self.count[x] -= 1
            if not self.count[x]:
                del self.values[bisect.bisect_left(self.values, x)]

    def give(self, filling: tuple[int, ...]) -> None:
        for x in filling:
            if not self.count[x]:
                bisect.insort(self.values, x)
            self.count[x] += 1


def _reachable(steps: list[int], counts: list[int], most: int) -> list[int]:
    """For each i, the sums up to `most` that the first i sizes can reach, as the bits of an integer."""
    mask, reach = (1 << (most + 1)) - 1, [1]
    for s, c in zip(steps, counts):
        bits, k = reach[-1], 1
        while c:
            k = min(k, c)
            bits |= (bits << (s * k)) & mask
            c -= k
            k *= 2
        reach.append(bits)
    return reach


def many_first(sizes: list[int], capacity: int) -> list[list[int]]:
    """Another first packing: around the largest item left, a fullest filling with the smallest items that reach it."""
    stock, bins = _Stock(sizes), []
    while stock.values:
        item = stock.values[-1]
        stock.take((item,))
        room = capacity - item
        unit = -(-room // FINEST) if room > FINEST else 1
        values = stock.values[: bisect.bisect_right(stock.values, room)][::-1]
        counts = [stock.count[v] for v in values]
        steps = [-(-v // unit) for v in values]
        reach = _reachable(steps, counts, room // unit)
        target, f = reach[-1].bit_length() - 1, []
        for j in range(len(values), 0, -1):
            c = min(counts[j - 1], target // steps[j - 1])
            while c and not reach[j - 1] >> (target - c * steps[j - 1]) & 1:
                c -= 1
            f += [values[j - 1]] * c
            target -= c * steps[j - 1]
        stock.take(tuple(f))
        bins.append([item, *f])
    return bins


def fillings(stock: _Stock, room: int, allowed: int, effort: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` that waste at most `allowed`, least waste first, large items first.

    Sums that the first i sizes can reach are kept as the bits of an integer, which rules out
    choices that lead to no filling; fillings may have any number of items. A choice is left out if another
    item, as large as one or two of the chosen or larger by no more than the waste, can take
    their place: what the filling allows, that one allows too. effort[0] counts down with each choice.
    """
    unit = -(-room // FINEST) if room > FINEST else 1  # sizes are rounded up where the room is very large
    top = bisect.bisect_right(stock.values, room)
    values = stock.values[:top]
    counts = [stock.count[v] for v in values]
    steps = [-(-v // unit) for v in values]
    full = room // unit
    reach = _reachable(steps, counts, full)

    def another(low: int, high: int, chosen: tuple[int, ...]) -> bool:
        """Whether an item of a size in [low, high] is left beside the chosen ones."""
        i = bisect.bisect_left(values, low)
        while i < top and values[i] <= high:
            if counts[i] > chosen.count(values[i]):
                return True
            i += 1
        return False

    def sets(i: int, target: int, waste: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not target:
            yield chosen
            return
        for j in range(bisect.bisect_right(steps, target, 0, i), 0, -1):  # the largest size to come
            v = values[j - 1]
            if effort[0] <= 0:
                return
            effort[0] -= 1
            if not (waste and another(v + 1, v + waste, chosen)) and not any(another(v + x, v + x + waste, chosen) for x in set(chosen)):
                for c in range(min(counts[j - 1], target // steps[j - 1]), 0, -1):
                    if c > 1 and another(2 * v, 2 * v + waste, chosen):
                        continue
                    if reach[j - 1] >> (target - c * steps[j - 1]) & 1:
                        yield from sets(j - 1, target - c * steps[j - 1], waste, (*chosen, *(v,) * c))
            if not reach[j - 1] >> target & 1:
                return

    def every() -> Iterator[tuple[int, ...]]:
        sums = reach[-1]
        while sums:
            target = sums.bit_length() - 1
            if (full - target) * unit > allowed:
                return
            sums ^= 1 << target
            for f in sets(top, target, max(0, room - target * unit) if unit == 1 else 0, ()):
                if room - sum(f) <= allowed:
                    yield f

    return every()


def bin_completion(sizes: list[int], capacity: int, effort: int | None = None) -> list[list[int]]:
    """Containers as lists of positive sizes.

    The search goes on until a packing meets the lower bound, until every branch is tried, or until it has
    made `effort` choices (default: EFFORT for each container of the incumbent; packing is NP-hard, so
    some end is needed). In the first two cases the packing has the fewest containers possible.
    """
    best = best_fit_decreasing(sizes, capacity)
    if len(best) > lower_bound(sizes, capacity):
        best = min(best, many_first(sizes, capacity), key=len)
    bound, total = lower_bound(sizes, capacity), sum(sizes)
    left = [EFFORT * len(best) if effort is None else effort]
    stock, done, waste = _Stock(sizes), [], 0

    def complete() -> None:
        """Open a branch: the largest item left, and what may go with it."""
        item = stock.values[-1]
        stock.take((item,))
        branches.append((item, fillings(stock, capacity - item, (len(best) - 1) * capacity - total - waste, left)))

    branches: list[tuple[int, Iterator[tuple[int, ...]]]] = []
    if len(best) > bound:
        complete()
    while branches and left[0] > 0:
        item, around = branches[-1]
        f = next(around, None)
        # more waste than this can't give fewer containers; later fillings of the branch waste no less
        if f is None or waste + capacity - item - sum(f) > (len(best) - 1) * capacity - total:
            branches.pop()
            stock.give((item,))
            if done:
                f = done.pop()
                stock.give(f[1:])
                waste -= capacity - sum(f)
            continue
        stock.take(f)
        if not stock.values:
            best = [list(b) for b in (*done, (item, *f))]
            stock.give(f)
            if len(best) <= bound:
                break
            continue
        done.append((item, *f))
        waste += capacity - item - sum(f)
        complete()
    return best


def pack(df: DataFrame, size: Column, id_col: str = "doc_id", capacity: int = 4096, group_items: int = GROUP_ITEMS, begins: Column | None = None) -> DataFrame:
    """(id, part, begin, size, container): where each item goes; sizes and begins in the units of `size`.

    An item that exceeds the capacity is cut into containers of its own and a rest (part 0, 1, ...); no
    other item is cut. `begins` (an array, for such items) says where the parts may begin, at most a capacity apart
    (default: full containers). Every row of `df` appears: a null or non-positive size counts as 0, and an
    item of size 0 takes no room (in a group without other items, it gets a container of its own).
    Equal ids are different items. `container` is unique over the result.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    zero, most = F.lit(0).cast("long"), F.lit(capacity).cast("long")
    whole = F.greatest(F.coalesce(size, F.lit(0)).cast("long"), zero)
    begins = F.sequence(zero, whole - 1, most) if begins is None else begins.cast("array<long>")
    items = df.select(F.col(id_col).alias("id"), whole.alias("whole"), F.xxhash64(*df.columns).alias("salt"), F.when(whole > capacity, begins).alias("begins"))
    items = materialize(items, "pack-items")  # texts are read once
    n, last = F.size("begins"), F.element_at("begins", -1)
    over = items.where(F.col("whole") > capacity).select("id", "salt", "begins", F.posexplode(F.slice("begins", F.lit(1), n - 1)).alias("part", "begin"))
    over = over.select("id", F.col("part").cast("int").alias("part"), "begin", (F.get("begins", F.col("part") + 1) - F.col("begin")).alias("size"), F.concat_ws(":", F.lit("x"), F.col("id").cast("string"), F.hex("salt"), "part").alias("container"))
    large = F.col("whole") > capacity
    small = items.select(
        "id",
        "salt",
        F.when(large, n - 1).otherwise(0).cast("int").alias("part"),
        F.when(large, last).otherwise(zero).alias("begin"),
        F.when(large, F.col("whole") - last).otherwise(F.col("whole")).alias("size"),
    )
    groups = max(1, math.ceil(small.count() / group_items))
    small = small.withColumn("g", F.pmod(F.xxhash64("id", "salt"), F.lit(groups)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "begin", "salt"], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy()
        at: dict[int, list[int]] = {}
        for i, s in enumerate(size.tolist()):
            at.setdefault(s, []).append(i)
        place = np.zeros(len(pdf), np.int64)  # items of size 0 share the first container
        for b, content in enumerate(bin_completion([s for s in size.tolist() if s > 0], capacity)):
            for s in content:
                place[at[s].pop()] = b
        g = pdf["g"].iloc[0]
        return pdf[["id", "part", "begin", "size"]].assign(container=[f"g:{g}:{b}" for b in place])

    id_type = df.schema[id_col].dataType.simpleString()
    # packing takes long for its bytes: as many partitions as cores can use, not as bytes suggest
    small = small.repartition(max(min(groups, tasks(df.sparkSession)), groups // 16), "g")
    packed = small.groupBy("g").applyInPandas(fill, f"id {id_type}, part int, begin long, size long, container string")
    return over.unionByName(packed)


def packing_report(placed: DataFrame, capacity: int) -> DataFrame:
    """(n_items, n_containers, used, over_full, fill, least_containers): how much of the containers is used, and how many hold too much (none)."""
    per = placed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    t = per.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.count_if(F.col("used") > capacity).alias("over_full"))
    return t.select("n_items", "n_containers", "used", "over_full", F.round(F.try_divide(F.col("used"), F.col("n_containers") * capacity), 6).alias("fill"), F.ceil(F.col("used") / capacity).alias("least_containers"))
