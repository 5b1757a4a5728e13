"""Best-fit packing of documents into containers of several permitted sizes.

Sizes are whole tokens, so the corpus is described completely by how many items
have each size: a table of at most ``capacity`` rows however many documents there
are.  Best-fit decreasing runs on that table on the driver, moving whole ranges
of equal bins at once; the executors then look up each item's bin by its size and
its rank among the items of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skriptor.session import cut, prepare

RANK_BLOCK = 200_000  # items ranked in one sorted group


def _lowest(mask: int) -> int:
    return (mask & -mask).bit_length() - 1


def least_cost(capacities: list[int]) -> Callable[[int, int, int], int]:
    """The opening rule: the permitted size with the least room a token, given what is left.

    A bin of size c takes as many items of the size at hand as fit; of the room that remains, so much
    is counted as filled as the smaller items still to come can fill in all bins opened now.
    """

    def opened(size: int, left: int, below: int) -> int:
        best = None
        for c in capacities:
            if c < size:
                continue
            own = min(c // size, left)
            bins = -(-left // own)
            used = own * size + min(c - own * size, below / bins)
            if best is None or c / used <= best[0] * (1 + 1e-9):
                best = c / used, c
        return best[1]

    return opened


def best_fit(hist: dict[int, int], capacities: list[int], opened: Callable[[int, int, int], int]) -> dict[str, np.ndarray]:
    """Best-fit decreasing over size counts; ``opened(size, left, below)`` names the bin size to open
    for ``left`` items of a size and ``below`` tokens of smaller ones.

    Gives placements (size, first rank, first bin, count) and bin ranges
    (first bin, count, content).
    """
    free: dict[int, list[tuple[int, int, int]]] = {}  # room left: ranges of (first, end, opened size)
    mask, bins, places, below = 0, 0, [], sum(s * n for s, n in hist.items() if s > 0)
    for size in sorted((s for s in hist if s > 0), reverse=True):
        left, rank = hist[size], 0
        below -= size * left
        while left:
            fits = mask >> size
            if not fits:
                cap = opened(size, left, below)
                n = -(-left // (cap // size))
                free.setdefault(cap, []).append((bins, bins + n, cap))
                mask |= 1 << cap
                bins += n
                continue
            room = size + _lowest(fits)
            first, end, cap = free[room].pop()
            k = min(left, end - first)
            if first + k < end:
                free[room].append((first + k, end, cap))
            if not free[room]:
                mask &= ~(1 << room)
            places.append((size, rank, first, k))
            free.setdefault(room - size, []).append((first, first + k, cap))
            mask |= 1 << (room - size)
            rank, left = rank + k, left - k
    ranges = sorted((a, b - a, cap - room) for room, held in free.items() for a, b, cap in held)
    if hist.get(0) and not ranges:
        ranges, bins = [(0, 1, 0)], 1
    return {
        "places": np.array(sorted(places), np.int64).reshape(-1, 4),
        "ranges": np.array(ranges, np.int64).reshape(-1, 3),
        "bins": bins,
    }


def plan(hist: dict[int, int], capacities: list[int]) -> dict[str, np.ndarray]:
    """The layout of the least-cost opening, or that of a fixed rule where this is cheaper after downsizing every bin.

    A fixed rule takes the smallest permitted size that holds ``q`` items of the
    size at hand; q runs from 1 (smallest bin) to unbounded (largest bin).
    """
    sizes = np.array(sorted(capacities))
    best = None
    fixed = [lambda s, left, below, q=q: int(next((c for c in sizes if c >= s * q), sizes[-1])) for q in (1, 1.5, 2, 3, 4, 8, float("inf"))]
    for rule in [least_cost(sorted(capacities)), *fixed]:
        result = best_fit(hist, capacities, rule)
        caps = sizes[np.searchsorted(sizes, result["ranges"][:, 2])]
        cost = int((caps * result["ranges"][:, 1]).sum())
        if best is None or (cost, result["bins"]) < best[0]:
            best = ((cost, result["bins"]), result | {"caps": caps.astype(np.int64)})
    return best[1]


def pack(items: DataFrame, capacities: list[int], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """Containers of every row of ``items``, one layout for each largest capacity.

    Result: layout (its largest capacity), container, capacity (the permitted size
    the container was cut down to), id, piece, tokens.  Layout C uses the permitted
    sizes up to C.  An item larger than C is cut into full pieces of C and a rest;
    no other item is cut.  Items of size 0 or null go into containers that are
    there already, or one empty container.  Repeated rows are separate items.
    """
    spark = prepare(items.sparkSession)
    caps = sorted({int(c) for c in capacities if c is not None and c > 0})
    if not caps:
        raise ValueError("no capacity above 0")
    id_type = items.schema[id_col].dataType.simpleString()
    base = items.select(F.col(id_col).alias("key"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    layouts = base.select("key", "n", F.explode(F.array(*[F.lit(c) for c in caps])).alias("layout"))
    last = F.greatest(F.ceil(F.col("n") / F.col("layout")) - 1, F.lit(0)).cast("int")
    pieces = layouts.select("key", "layout", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "key", "layout", "piece", F.least(F.col("layout").cast("long"), F.col("n") - F.col("piece") * F.col("layout")).cast("int").alias("size")
    )
    pieces = cut(pieces)
    counts = pieces.groupBy("layout", "size").count()
    hist: dict[int, dict[int, int]] = {c: {} for c in caps}
    for r in counts.collect():  # at most capacity + 1 rows a layout
        hist[r["layout"]][r["size"]] = r["count"]
    plans = {c: plan(hist[c], [x for x in caps if x <= c]) for c in caps}
    shared = spark.sparkContext.broadcast(plans)

    blocks = spark.createDataFrame(
        [(c, s, -(-n // RANK_BLOCK)) for c in caps for s, n in hist[c].items()] or [(caps[0], -1, 1)], "layout int, size int, blocks long"
    )
    salted = pieces.join(F.broadcast(blocks), ["layout", "size"]).withColumn("block", F.expr("pmod(xxhash64(key, piece), blocks)")).drop("blocks")
    group = ["layout", "size", "block"]
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("key", "piece")))
    per_block = salted.groupBy(*group).count()
    before = Window.partitionBy("layout", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = ranked.join(offsets, group).select("key", "layout", "piece", "size", (F.col("r") - 1 + F.col("before")).alias("rank"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            bins, room = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for c, p in shared.value.items():
                own = (x["layout"] == c).to_numpy()
                if not own.any():
                    continue
                size, rank = x.loc[own, "size"].to_numpy(np.int64), x.loc[own, "rank"].to_numpy(np.int64)
                if len(places := p["places"]):
                    at = np.searchsorted((places[:, 0] << 44) + places[:, 1], (size << 44) + rank, side="right") - 1
                    at = np.maximum(at, 0)
                    b = np.where(size > 0, places[at, 2] + rank - places[at, 1], rank % max(p["bins"], 1))
                else:
                    b = np.zeros(len(size), np.int64)
                bins[own] = b
                room[own] = p["caps"][np.searchsorted(p["ranges"][:, 0], b, side="right") - 1]
            yield pd.DataFrame({"layout": x["layout"], "container": bins, "capacity": room, "key": x["key"], "piece": x["piece"], "tokens": x["size"]})

    out = ranked.mapInPandas(assign, f"layout int, container bigint, capacity int, key {id_type}, piece int, tokens int")
    return out.select("layout", "container", "capacity", F.col("key").alias(id_col), "piece", "tokens")


def containers(packed: DataFrame) -> DataFrame:
    """(layout, container, capacity, items, tokens, unused) of each container."""
    return packed.groupBy("layout", "container").agg(
        F.max("capacity").alias("capacity"),
        F.count(F.lit(1)).alias("items"),
        F.sum("tokens").alias("tokens"),
        (F.max("capacity") - F.sum("tokens")).alias("unused"),
    )
