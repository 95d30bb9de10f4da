"""Filling containers of fixed capacity with items, from the histogram of lengths (after Krell et al., 2021).

The plan is made on the histogram alone, which has at most ``capacity`` entries at any data size. Windows of a
quarter of the next one's size are filled from the smallest up: combinations of at most four lengths that fill the window
are enumerated, non-negative least squares finds how often to use each so that the histogram is used up, and the rounded
counts become bundles that count as items of the next window. What is left is packed greedily, length class by length class.
Items then find their container from their rank among the items of equal length.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Units a window is divided into, lengths in a combination, share of the total length kept back to fill gaps.
UNITS, PARTS, HELD_BACK = 64, 4, 0.05
#: Rows of one length ranked in one task, roughly. The ranks are the same whatever its value.
RANK_ROWS = 200_000
_FLIP = -(1 << 63)


@dataclass
class Bundle:
    """``count`` equal groups of items: length of each and how many items of each length it holds."""

    size: int
    count: int
    holds: dict[int, int]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[0] + 20):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tol:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] = x[at] + step * (z - x[at])
            free[at[x[at] <= 1e-12 * max(1.0, x.max())]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def combinations(bins: list[int], units: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``parts`` of the bins that fill ``units``, or all but one of them."""
    out: list[tuple[int, ...]] = []
    have = sorted(bins, reverse=True)

    def grow(head: tuple[int, ...], room: int, start: int) -> None:
        if head and room <= 1:
            out.append(head)
        if room and len(head) < parts:
            for k in range(start, len(have)):
                size = have[k]
                if size * (parts - len(head)) < room - 1:
                    break
                if size <= room:
                    grow((*head, size), room - size, k)

    grow((), units, 0)
    return out


def _merge(slots: list[list[tuple[Bundle, int]]]) -> list[Bundle]:
    """Bundles from slots that each list (item, how many): cut wherever one of the slots changes its item."""
    out, at = [], [[0, slot[0][1]] for slot in slots]
    while all(k < len(slot) for (k, _), slot in zip(at, slots)):
        n = min(left for _, left in at)
        holds: Counter = Counter()
        for (k, _), slot in zip(at, slots):
            holds.update(slot[k][0].holds)
        out.append(Bundle(sum(size * m for size, m in holds.items()), n, dict(holds)))
        for place, slot in zip(at, slots):
            place[1] -= n
            if not place[1]:
                place[0] += 1
                if place[0] < len(slot):
                    place[1] = slot[place[0]][1]
    return out


def _fill_window(items: list[Bundle], window: int) -> tuple[list[Bundle], list[Bundle]]:
    """Bundles that fill ``window`` (nearly), and the items left over."""
    units = min(UNITS, window)
    stock: dict[int, list[Bundle]] = defaultdict(list)
    for item in sorted(items, key=lambda i: -i.size):
        stock[-(-item.size * units // window)].append(item)
    made: list[Bundle] = []
    for _ in range(3):  # what rounding leaves is solved for again
        have = {q: sum(i.count for i in group) for q, group in stock.items()}
        bins = [q for q, n in have.items() if n]
        uses = combinations(bins, units)
        if not uses:
            break
        row = {q: k for k, q in enumerate(bins)}
        a = np.zeros((len(bins), len(uses)))
        for k, use in enumerate(uses):
            for q in use:
                a[row[q], k] += 1
        b = np.array([have[q] for q in bins], dtype=float)
        scale = 1 / np.sqrt(b)
        x = nnls(a * scale[:, None], b * scale)
        before = len(made)
        for k in np.argsort(-x):
            need = Counter(uses[k])
            n = min([int(x[k] + 0.5), *(have[q] // m for q, m in need.items())])
            if n <= 0:
                continue
            slots = []
            for q in uses[k]:
                have[q] -= n
                want, slot = n, []
                while want:
                    item = stock[q][0]
                    take = min(want, item.count)
                    slot.append((item, take))
                    want -= take
                    if take == item.count:
                        stock[q].pop(0)
                    else:
                        stock[q][0] = Bundle(item.size, item.count - take, item.holds)
                slots.append(slot)
            made += _merge(slots)
        if len(made) == before:
            break
    return made, [item for group in stock.values() for item in group]


def _fill_gaps(made: list[Bundle], spare: list[Bundle], capacity: int) -> tuple[list[Bundle], list[Bundle]]:
    """Put spare items, the longest first, where they leave least room; then open containers for the rest, in patterns."""
    import bisect

    room: dict[int, list[Bundle]] = defaultdict(list)
    for bundle in made:
        room[capacity - bundle.size].append(bundle)
    rooms = sorted(room)
    left: dict[int, int] = Counter()
    for item in spare:
        left_key = item.size
        if len(item.holds) == 1 and sum(item.holds.values()) == 1:
            left[left_key] += item.count
        else:  # a bundle that found no window is taken apart
            for size, m in item.holds.items():
                left[size] += m * item.count
    for size in sorted(left, reverse=True):
        while left[size]:
            k = bisect.bisect_left(rooms, size)
            while k < len(rooms) and not room[rooms[k]]:
                rooms.pop(k)
            if k >= len(rooms):
                break
            gap = rooms[k]
            bundle = room[gap].pop()
            m = min(gap // size, max(1, left[size] // bundle.count))
            n = min(bundle.count, left[size] // m)
            if n < bundle.count:
                room[gap].append(Bundle(bundle.size, bundle.count - n, bundle.holds))
            holds = Counter(bundle.holds)
            holds[size] += m
            new = Bundle(bundle.size + m * size, n, dict(holds))
            if not room[capacity - new.size]:
                bisect.insort(rooms, capacity - new.size)
            room[capacity - new.size].append(new)
            left[size] -= m * n
    done = [bundle for group in room.values() for bundle in group]
    sizes = sorted((s for s, n in left.items() if n), reverse=True)
    opened: list[Bundle] = []
    while sizes:
        holds, space = Counter(), capacity
        for size in sizes:
            m = min(space // size, left[size])
            if m:
                holds[size] = m
                space -= m * size
        n = min(left[size] // m for size, m in holds.items())
        opened.append(Bundle(capacity - space, n, dict(holds)))
        for size, m in holds.items():
            left[size] -= m * n
        sizes = [s for s in sizes if left[s]]
    return done, opened


def plan_containers(histogram: dict[int, int], capacity: int) -> list[Bundle]:
    """Kinds of containers, with how many of each, that hold exactly the items of the histogram (lengths 1 to capacity)."""
    if any(not 0 < size <= capacity for size in histogram):
        raise ValueError("lengths lie between 1 and the capacity")
    stock = {size: n for size, n in sorted(histogram.items()) if n}
    full = [Bundle(capacity, stock.pop(capacity), {capacity: 1})] if capacity in stock else []
    budget, held = HELD_BACK * sum(s * n for s, n in stock.items()), []
    for size in sorted(stock):  # the shortest items wait to fill gaps
        n = min(stock[size], int(budget // size))
        if n <= 0:
            break
        held.append(Bundle(size, n, {size: 1}))
        budget -= size * n
        stock[size] -= n
    windows = [capacity]
    while windows[-1] // 4 >= 16:
        windows.append(windows[-1] // 4)
    pool: list[Bundle] = []
    bound = 0
    made: list[Bundle] = []
    for window in reversed(windows):
        pool += [Bundle(size, n, {size: 1}) for size, n in stock.items() if bound < size <= window and n]
        bound = window
        made, rest = _fill_window(pool, window)
        pool = made + rest
    done, opened = _fill_gaps(made, rest + held, capacity)
    return full + done + opened


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(``id_col``, piece, n_pieces, start, size, container): where each item, or each piece of it, goes.

    An item longer than ``capacity`` is cut into full pieces and a rest, numbered from 0; no other is cut. Items of unknown
    size or size 0 and less take no room: one row with container NULL. Containers are numbered from 0 without gaps and
    never exceed the capacity. Repeated rows are items of their own. An empty input gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity is at least 1")
    n = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    cut = items.select(F.col(id_col), n.alias("__n")).withColumn("n_pieces", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("__n") / capacity)))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)))
    start = F.col("piece") * capacity
    cut = materialize(cut.select(id_col, "piece", "n_pieces", start.alias("start"), F.least(F.col("__n") - start, F.lit(capacity)).alias("size")), "pieces")
    histogram = {r["size"]: r["count"] for r in cut.where("size > 0").groupBy("size").count().collect()}  # at most `capacity` rows
    offsets = np.zeros(capacity + 1, dtype=np.int64)  # items shorter than each length: rank and length in one number
    at = 0
    for size in range(1, capacity + 1):
        offsets[size] = at
        at += histogram.get(size, 0)
    bounds, first = [], 0
    used: Counter = Counter()
    for bundle in plan_containers(histogram, capacity):
        for size, m in bundle.holds.items():
            bounds.append((offsets[size] + used[size], first, m))
            used[size] += m * bundle.count
        first += bundle.count
    if used != Counter(histogram):
        raise AssertionError("the plan doesn't use up the histogram")
    table = np.array(sorted(bounds), dtype=np.int64).reshape(-1, 3)
    plan = items.sparkSession.sparkContext.broadcast((offsets, *np.ascontiguousarray(table.T)))  # bounded by the capacity, not by the data

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        base, start, first, each = plan.value
        key = base[size.to_numpy()] + rank.to_numpy()
        at = np.searchsorted(start, key, side="right") - 1
        return pd.Series(first[at] + (key - start[at]) // each[at])

    # items of one length rank in the order of a hash as an unsigned number, whose top bits give the part that one task ranks
    bits = max(0, math.ceil(math.log2(max(histogram.values(), default=1) / RANK_ROWS)))
    h = F.xxhash64(id_col, "piece")
    placed = cut.where("size > 0").withColumn("__h", h.bitwiseXOR(F.lit(_FLIP))).withColumn("__part", F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint"))
    placed = placed.withColumn("__in", F.row_number().over(W.partitionBy("size", "__part").orderBy("__h", id_col, "piece")) - 1)
    if bits:
        before = placed.groupBy("size", "__part").agg(F.count(F.lit(1)).alias("__c"))
        before = before.select("size", "__part", (F.sum("__c").over(W.partitionBy("size").orderBy("__part")) - F.col("__c")).alias("__before"))
        placed = placed.join(before, ["size", "__part"])
    else:
        placed = placed.withColumn("__before", F.lit(0))
    placed = placed.select(id_col, "piece", "n_pieces", "start", "size", container("size", F.col("__before") + F.col("__in")).alias("container"))
    return placed.unionByName(cut.where("size = 0").withColumn("container", F.lit(None).cast("bigint")))  # these aren't ranked, however many there are


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """Per container: its pieces, its filled length and the share of the capacity."""
    per = packed.where("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("filled"))
    return per.withColumn("fill", F.col("filled") / capacity)
