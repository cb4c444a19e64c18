"""Which experts stay resident and how many bits each keeps."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The default ladder of precisions as (bits, label), most precise first.
LADDER = ((6.5625, "Q6_K"), (5.5, "Q5_K"), (4.5, "Q4_K"), (3.4375, "Q3_K"), (2.625, "Q2_K"))
#: Measured bandwidths in bytes per second.
RESIDENT_BPS, STORAGE_BPS = 30.0e9, 2.41e9


@dataclass(frozen=True)
class Config:
    weights_per_expert: int
    resident_budget: int
    baseline_bits: float = 4.5
    ladder: tuple = LADDER
    resident_bps: float = RESIDENT_BPS
    storage_bps: float = STORAGE_BPS
    #: ("absolute", error), ("uniform", bits) or ("relative", factor).
    error_budget: tuple = ("uniform", 4.5)
    protected: frozenset = field(default_factory=frozenset)
    #: Refuses every demotion while nothing is protected: the safe way to fail.
    require_protection: bool = True
    floor_bits: float = 2.5


def finite(sens: DataFrame) -> DataFrame:
    """Measured sensitivities (layer, expert, bits, error) without rows that aren't finite."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return sens.where(good("bits") & good("error"))


def loss_at(asked: DataFrame, sens: DataFrame) -> DataFrame:
    """asked (layer, expert, at_bits, ...) with loss: the error at the nearest measured bits (ties to the first row by ord),
    or 4^-bits where an expert has no measurement."""
    rows = finite(sens).groupBy("layer", "expert").agg(F.sort_array(F.collect_list(F.struct("ord", "bits", "error"))).alias("m"))
    best = F.aggregate(
        "m",
        F.struct(F.lit(float("inf")).alias("d"), F.lit(None).cast("double").alias("e")),
        lambda a, x: F.when(F.abs(x["bits"] - F.col("at_bits")) < a["d"], F.struct(F.abs(x["bits"] - F.col("at_bits")).alias("d"), x["error"].alias("e"))).otherwise(a),
        lambda a: a["e"],
    )
    return asked.join(rows, ["layer", "expert"], "left").withColumn("loss", F.coalesce(best, F.pow(F.lit(4.0), -F.col("at_bits")))).drop("m")


def residents(freq: DataFrame, expert_bytes: int, budget: int) -> DataFrame:
    """freq (layer, expert, n) with resident: the hottest experts that fit the budget at equal size, ties to the smaller id."""
    room = budget // expert_bytes if expert_bytes > 0 else 0
    order = Window.partitionBy("layer").orderBy(F.desc("n"), "expert")
    return freq.withColumn("resident", F.row_number().over(order) <= room)


def hit_rate(freq: DataFrame) -> DataFrame:
    """(layer, hit_rate): the residents' share of selections; 0 without any."""
    total = F.sum("n")
    return freq.groupBy("layer").agg(F.when(total > 0, F.sum(F.when(F.col("resident"), F.col("n")).otherwise(0)) / total).otherwise(F.lit(0.0)).alias("hit_rate"))


def weighted(freq: DataFrame, tokens: int, value: Column) -> DataFrame:
    """(layer, expected): the sum of a value over experts, each weighed by its selections per token."""
    return freq.groupBy("layer").agg(F.sum(F.col("n") / F.lit(float(max(tokens, 1))) * value).alias("expected"))


def ladder(config: Config) -> list[tuple[float, str]]:
    """The source's precision, then the rungs strictly below it, falling."""
    below = sorted((r for r in config.ladder if r[0] < config.baseline_bits - 1e-9), key=lambda r: -r[0])
    return [(config.baseline_bits, "keep"), *below]


def plan_layer(freq: np.ndarray, tokens: int, loss, config: Config) -> tuple[list[dict], dict]:
    """One layer: the hottest experts stay resident, then bits are taken where they save most time for the error they add.

    loss(expert, bits) is the error of storing an expert so. Each step down the ladder has a fixed saving and added error. Steps
    that add none are taken first, others by saving per added error (ties to the smaller id) while the sum stays under the
    ceiling. A heap holds the next step of every expert; those above the ceiling wait until a step lowers the sum.
    """
    n, rungs = len(freq), ladder(config)
    bits = np.array([b for b, _ in rungs])
    size = np.ceil(config.weights_per_expert * bits / 8)
    rate = freq / max(tokens, 1)
    room = int(config.resident_budget // size[0]) if size[0] else 0
    resident = np.zeros(n, bool)
    resident[np.lexsort((np.arange(n), -freq))[:room]] = True
    bps = np.where(resident, config.resident_bps, config.storage_bps)[:, None]
    seconds = np.divide(size, bps, out=np.zeros((n, len(rungs))), where=bps > 0)
    errors = np.array([[loss(e, b) for b in bits] for e in range(n)], float).reshape(n, len(rungs))
    added, saved = rate[:, None] * np.diff(errors), -rate[:, None] * np.diff(seconds)
    kind, value = config.error_budget
    uniform = lambda b: float(sum(rate[e] * loss(e, b) for e in range(n)))
    ceiling = {"absolute": lambda: value, "uniform": lambda: uniform(value), "relative": lambda: uniform(config.baseline_bits) * value}[kind]()
    at, experts = np.zeros(n, int), np.arange(n)
    now = before_loss = float((rate * errors[:, 0]).sum())
    lowest = int((bits >= config.floor_bits).sum()) - 1

    def step(e: int) -> list[tuple[bool, float, int]]:
        k = at[e]
        if k >= lowest or e in config.protected:
            return []
        if added[e, k] <= 0:
            return [(False, 0.0, e)]
        return [(True, -saved[e, k] / added[e, k], e)] if saved[e, k] > 0 else []

    heap = [] if config.require_protection and not config.protected else [s for e in range(n) for s in step(e)]
    heapq.heapify(heap)
    waiting: list = []
    while heap:
        costly, _, e = first = heapq.heappop(heap)
        more = added[e, at[e]]
        if costly and now + more > ceiling:
            waiting.append(first)
            continue
        at[e] += 1
        now += more
        for s in step(e) + (waiting if more < 0 else []):
            heapq.heappush(heap, s)
        waiting = [] if more < 0 else waiting
    rows = [
        {"expert": e, "freq": int(freq[e]), "tier": "resident" if resident[e] else "storage", "bits": rungs[at[e]][0], "label": rungs[at[e]][1], "bytes": int(size[at[e]])}
        for e in range(n)
    ]
    before, after = float((rate * seconds[:, 0]).sum()), float((rate * seconds[experts, at]).sum())
    summary = {
        "resident_bytes": sum(r["bytes"] for r in rows if r["tier"] == "resident"),
        "baseline_seconds": before,
        "planned_seconds": after,
        "baseline_loss": before_loss,
        "planned_loss": float((rate * errors[experts, at]).sum()),
        "speedup": before / after if after > 0 else 1.0,
    }
    return rows, summary


ALLOC = "layer int, expert int, freq long, tier string, bits double, label string, bytes long, baseline_seconds double, planned_seconds double, baseline_loss double, planned_loss double, speedup double, resident_bytes long"


def allocate(freq: DataFrame, sens: DataFrame, tokens: int, config: Config) -> DataFrame:
    """A plan per layer from freq (layer, expert, n) with every expert and sens (layer, expert, ord, bits, error)."""
    rows = finite(sens).groupBy("layer", "expert").agg(F.sort_array(F.collect_list(F.struct("ord", "bits", "error"))).alias("m"))
    joined = freq.join(rows, ["layer", "expert"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("expert")
        measured = [[(r["bits"], r["error"]) for r in m] if m is not None else [] for m in pdf["m"]]

        def loss(e: int, bits: float) -> float:
            return min(measured[e], key=lambda r: abs(r[0] - bits))[1] if measured[e] else 4.0**-bits

        plan, summary = plan_layer(pdf["n"].to_numpy(), tokens, loss, config)
        out = pd.DataFrame(plan)
        out["layer"] = int(pdf["layer"].iloc[0])
        for k, v in summary.items():
            out[k] = v
        return out[[c.split()[0] for c in ALLOC.split(", ")]]

    return joined.groupBy("layer").applyInPandas(run, ALLOC)


def nearest_native(bits: Column) -> Column:
    """The native type whose bits per weight are nearest, the first of them on ties."""
    from ..functions.scalars import NATIVE_TYPES, group_bytes

    cells = [F.struct(F.abs(bits - group_bytes(n) * 8 / 64).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, *_) in enumerate(NATIVE_TYPES)]
    return F.least(*cells)["name"]


def demoted_any(alloc: DataFrame, baseline_bits: float) -> DataFrame:
    return alloc.groupBy("layer").agg(F.max(F.col("bits") < baseline_bits).alias("demoted"))
