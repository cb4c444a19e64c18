"""Expert order on disk: what an order costs, a greedy order by co-activation, and local search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import surface as surfaces


def identity(n_experts: int, layers: DataFrame) -> DataFrame:
    return layers.select("layer", F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias("expert")).select("layer", F.col("expert").alias("slot"), "expert")


def check_permutation(layout: DataFrame, n_experts: int) -> DataFrame:
    """Layers whose layout is not a bijection of 0..n_experts-1, with what is wrong."""
    seen = layout.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("slot").alias("slots"),
        F.countDistinct("expert").alias("experts"), F.min(F.least("slot", "expert")).alias("lo"), F.max(F.greatest("slot", "expert")).alias("hi"))
    return seen.where((F.col("rows") != n_experts) | (F.col("slots") != n_experts) | (F.col("experts") != n_experts) | (F.col("lo") != 0) | (F.col("hi") != n_experts - 1))


def slots_of(wide: DataFrame, layout: DataFrame) -> DataFrame:
    """(token, layer, slots): the sorted distinct slots of each token's experts.

    A layer's layout is one small map (a slot per expert) joined by layer, so tokens are not shuffled by expert.
    """
    maps = layout.groupBy("layer").agg(F.map_from_entries(F.collect_list(F.struct("expert", "slot"))).alias("m"))
    return wide.join(F.broadcast(maps), "layer").select("token", "layer", F.array_sort(F.array_distinct(F.transform("experts", lambda e: F.element_at("m", e)))).alias("slots"))


def shape(slots: DataFrame, merge_gap: int = 0) -> DataFrame:
    """(token, layer, runs, span): runs of slots that one request reads, joined over gaps of merge_gap, and slots read."""
    out = F.aggregate(
        "slots",
        F.struct(F.lit(0).alias("runs"), F.lit(0).alias("span"), F.lit(None).cast("int").alias("last")),
        lambda a,
            s: F.when(a["last"].isNull() | (s > a["last"] + 1 + merge_gap),
                F.struct((a["runs"] + 1).alias("runs"), (a["span"] + 1).alias("span"), s.alias("last"))).otherwise(F.struct(a["runs"].alias("runs"),
                    (a["span"] + s - a["last"]).alias("span"), s.alias("last"))),
        lambda a: F.struct(a["runs"].alias("runs"), a["span"].alias("span")),
    )
    return slots.select("token", "layer", out.alias("s")).select("token", "layer", "s.runs", "s.span")


def cost(shapes: DataFrame, surface: DataFrame, slice_bytes: int, tensors: int, queue_depth: int) -> DataFrame:
    """(layer, seconds_per_token, bytes_per_token, requests_per_token) of a layout.

    A request's time follows the bandwidth at the mean request size; with an empty surface, seconds are requests.
    """
    t = max(1, tensors)
    rows = shapes.select("layer", (F.col("runs") * t).cast("long").alias("requests"),
        (F.col("span").cast("long") * slice_bytes * t).alias("bytes")).groupBy("layer", "requests", "bytes").agg(F.count(F.lit(1)).alias("n"))
    mean = F.when(F.col("requests") > 0, F.floor(F.col("bytes") / F.col("requests"))).otherwise(0)
    asked = rows.withColumn("blob_bytes", F.greatest(mean, F.lit(1)).cast("long")).withColumn("queue_depth", F.lit(queue_depth))
    timed = surfaces.lookup(asked, surface).withColumn("seconds", F.when(F.col("bytes_per_sec") > 0, F.col("bytes") / F.col("bytes_per_sec")).otherwise(F.col("requests").cast("double")))
    avg = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n"))
    return timed.groupBy("layer").agg(avg("seconds").alias("seconds_per_token"), avg("bytes").alias("bytes_per_token"), avg("requests").alias("requests_per_token"))


def speedup(before: DataFrame, after: DataFrame, least: float = 1.05) -> DataFrame:
    """(layer, speedup, worth_repacking)."""
    a = after.select("layer", F.col("seconds_per_token").alias("after"))
    ratio = F.when(F.col("after") > 0, F.col("seconds_per_token") / F.col("after")).otherwise(F.lit(1.0))
    return before.join(a, "layer").select("layer", ratio.alias("speedup")).withColumn("worth_repacking", F.col("speedup") >= least)


def greedy_order(n: int, pairs: dict[tuple[int, int], int]) -> list[int]:
    """Starts with the heaviest pair and appends whoever goes best with the last one, then with the last four; ties to
    the smaller id."""
    if n == 0:
        return []
    co = np.zeros((n, n), np.int64)
    for (a, b), w in pairs.items():
        co[a, b] = co[b, a] = w
    top = np.triu(co, 1)
    order = [0]
    if top.max(initial=0) > 0:
        a, b = divmod(int(top.argmax()), n)
        order = [a, b]
    left = np.ones(n, bool)
    left[order] = False
    while left.any():
        ids = np.flatnonzero(left)
        near, recent = co[order[-1], ids], co[order[-4:]][:, ids].sum(0)
        pick = int(ids[np.lexsort((ids, -recent, -near))[0]])
        order.append(pick)
        left[pick] = False
    return order


class Costing:
    """Exact mean cost of slot orders over a layer's distinct expert sets with their counts."""

    def __init__(self, sets: np.ndarray, counts: np.ndarray, cells: list, slice_bytes: int, tensors: int, depth: int, gap: int) -> None:
        self.sets, self.counts, self.gap = sets, counts, gap
        self.slice, self.tensors, self.total = slice_bytes, max(1, tensors), max(1, int(counts.sum()))
        if cells:
            size, qd, bw = (np.array(x, float) for x in zip(*[(c[1], c[2], c[3]) for c in cells], strict=True))
            self.bw, self.log, self.depth = bw, np.log(size), np.abs(np.log(depth / qd))
        else:
            self.bw = None

    def seconds(self, slot_of: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        sets = self.sets if rows is None else self.sets[rows]
        slots = np.sort(slot_of[sets], 1)
        step = np.diff(slots, axis=1)
        broken = step > 1 + self.gap
        runs = 1 + broken.sum(1)
        span = 1 + np.where(broken, 1, step).sum(1)
        requests, moved = runs * self.tensors, span * self.slice * self.tensors
        if self.bw is None:
            return requests.astype(float)
        mean = np.maximum(1, moved // requests)
        values, at = np.unique(mean, return_inverse=True)
        near = np.argmin(np.abs(np.log(values)[:, None] - self.log) + self.depth, 1)
        return moved / self.bw[near][at]

    def mean(self, slot_of: np.ndarray) -> float:
        return float((self.seconds(slot_of) * self.counts).sum() / self.total)


def search(n: int, costing: Costing, pairs: dict[tuple[int, int], int], passes: int = 6, partners: int = 12, least_gain: float = 1e-3) -> tuple[list[int], float, float]:
    """(expert at each slot, seconds of the identity order, seconds of the result).

    From the greedy order, each expert in turn may swap into a slot beside a strong partner; the best improving swap is
    made. Only sets that hold one of the two swapped experts are costed anew, all of them exactly. A pass that gains less
    than least_gain ends the search; the best order after a pass wins.
    """
    order = np.array(greedy_order(n, pairs))
    slot_of = np.empty(n, np.int64)
    slot_of[order] = np.arange(n)
    holders = [np.flatnonzero((costing.sets == e).any(1)) for e in range(n)]
    strong: list[list[int]] = [[] for _ in range(n)]
    for (a, b), w in pairs.items():
        if w > 0:
            strong[a].append((-w, b))
            strong[b].append((-w, a))
    strong = [[e for _, e in sorted(s)[:partners]] for s in strong]
    base = costing.mean(np.arange(n))
    best, best_cost = slot_of.copy(), costing.mean(slot_of)
    for _ in range(passes):
        for e in range(n):
            pick, gain = None, -1e-15
            for p in strong[e]:
                for target in {max(0, slot_of[p] - 1), min(n - 1, slot_of[p] + 1)}:
                    other = int(np.flatnonzero(slot_of == target)[0])
                    if other == e:
                        continue
                    rows = np.union1d(holders[e], holders[other])
                    if not len(rows):
                        continue
                    old = (costing.seconds(slot_of, rows) * costing.counts[rows]).sum()
                    trial = slot_of.copy()
                    trial[e], trial[other] = trial[other], trial[e]
                    delta = ((costing.seconds(trial, rows) * costing.counts[rows]).sum() - old) / costing.total
                    if delta < gain:
                        pick, gain = other, delta
            if pick is not None:
                slot_of[e], slot_of[pick] = slot_of[pick], slot_of[e]
        now = costing.mean(slot_of)
        if now >= best_cost:
            break
        enough = (best_cost - now) / best_cost >= least_gain
        best, best_cost = slot_of.copy(), now
        if not enough:
            break
    at = np.empty(n, np.int64)
    at[best] = np.arange(n)
    return at.tolist(), base, best_cost


def optimise(wide: DataFrame, surface: DataFrame, n_experts: int, slice_bytes: int, tensors: int = 3, queue_depth: int = 8, merge_gap: int = 0, passes: int = 6) -> DataFrame:
    """(layer, slot, expert, seconds_before, seconds_after): a searched order per layer.

    A layer's tokens are reduced to its distinct expert sets with counts before one task gets them.
    """
    cells = [tuple(r) for r in surfaces.bounded(surface).orderBy("cell_idx").select("cell_idx", "blob_bytes", "queue_depth", "bytes_per_sec").collect()]  # at most MOST_CELLS rows
    sets = wide.select("layer", F.array_sort(F.array_distinct("experts")).alias("s")).groupBy("layer", "s").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["s"]))
        mat = np.array([list(x) + [x[-1]] * (width - len(x)) for x in pdf["s"]], np.int64)  # a repeated id changes no cost
        counts = pdf["n"].to_numpy()
        pairs: dict[tuple[int, int], int] = {}
        for x, c in zip(pdf["s"], counts, strict=True):
            for i, a in enumerate(x):
                for b in x[i + 1 :]:
                    pairs[a, b] = pairs.get((a, b), 0) + int(c)
        at, before, after = search(n_experts, Costing(mat, counts, cells, slice_bytes, tensors, queue_depth, merge_gap), pairs, passes)
        return pd.DataFrame({"layer": int(pdf["layer"].iloc[0]), "slot": range(n_experts), "expert": at, "seconds_before": before, "seconds_after": after})

    return sets.groupBy("layer").applyInPandas(run, "layer int, slot int, expert int, seconds_before double, seconds_after double")


def seriation(pairs: DataFrame, n_experts: int) -> DataFrame:
    """(layer, slot, expert): the greedy order alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = greedy_order(n_experts, {(a, b): n for a, b, n in zip(pdf["ea"], pdf["eb"], pdf["n"], strict=True)})
        return pd.DataFrame({"layer": int(pdf["layer"].iloc[0]), "slot": range(n_experts), "expert": order})

    return pairs.groupBy("layer").applyInPandas(run, "layer int, slot int, expert int")
