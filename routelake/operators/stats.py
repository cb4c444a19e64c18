"""Statistics of routing traces: frequency, co-activation, windows, reuse, transitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(trace: DataFrame, n_experts: int | None = None) -> DataFrame:
    """(layer, expert, n): selections; with n_experts, also those never selected, as 0."""
    counts = trace.groupBy("layer", "expert").agg(F.count(F.lit(1)).alias("n"))
    if n_experts is None:
        return counts
    every = trace.select("layer").distinct().select("layer", F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias("expert"))
    return every.join(counts, ["layer", "expert"], "left").select("layer", "expert", F.coalesce("n", F.lit(0)).alias("n"))


def pairs_of(experts: Column) -> Column:
    """All pairs ea < eb of an array of distinct ids."""
    ids = F.array_sort(F.array_distinct(experts))
    return F.flatten(F.transform(ids, lambda a, i: F.transform(F.slice(ids, i + 2, F.size(ids)), lambda b: F.struct(a.alias("ea"), b.alias("eb")))))


def coactivation(wide: DataFrame) -> DataFrame:
    """(layer, ea, eb, n), ea < eb: tokens that select both. Pairs are made inside the row; only counts are shuffled."""
    return wide.select("layer", F.inline(pairs_of(F.col("experts")))).groupBy("layer", "ea", "eb").agg(F.count(F.lit(1)).alias("n"))


def to_wide(trace: DataFrame) -> DataFrame:
    """(token, layer, experts) of a long trace; a token's experts of one layer are few by definition."""
    return trace.groupBy("token", "layer").agg(F.array_sort(F.collect_list("expert")).alias("experts"))


def hot_rank(freq: DataFrame) -> DataFrame:
    """(layer, expert, n, hot_rank): by count, then id; 1 is the hottest."""
    return freq.withColumn("hot_rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("n"), "expert")))


def mass_in_top(freq: DataFrame, tops: list[int]) -> DataFrame:
    """(layer, top, mass): the share of selections that the hottest `top` experts take; 0 where there are none."""
    ranked = hot_rank(freq)
    cells = [F.sum(F.when(F.col("hot_rank") <= t, F.col("n")).otherwise(0)).alias(f"m{t}") for t in tops]
    sums = ranked.groupBy("layer").agg(F.sum("n").alias("total"), *cells)
    rows = F.array(*[F.struct(F.lit(t).alias("top"), F.when(F.col("total") > 0, F.col(f"m{t}") / F.col("total")).otherwise(F.lit(0.0)).alias("mass")) for t in tops])
    return sums.select("layer", F.inline(rows))


def top_partners(pairs: DataFrame, k: int) -> DataFrame:
    """(layer, expert, partner, n, rank): each expert's k strongest partners with a count above 0, ties to the smaller id."""
    both = pairs.where("n > 0").select("layer",
        F.inline(F.array(F.struct(F.col("ea").alias("expert"), F.col("eb").alias("partner"), F.col("n")), F.struct(F.col("eb").alias("expert"), F.col("ea").alias("partner"), F.col("n")))))
    order = Window.partitionBy("layer", "expert").orderBy(F.desc("n"), "partner")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def never_selected(trace: DataFrame, n_experts: int) -> DataFrame:
    """(layer, expert) of ids below n_experts that no token selects."""
    every = trace.select("layer").distinct().select("layer", F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias("expert"))
    return every.join(trace.select("layer", "expert").distinct(), ["layer", "expert"], "left_anti")


def window_union(wide: DataFrame, widths: list[int], n_tokens: int, top_k: int, n_experts: int) -> DataFrame:
    """(layer, w, mean_union): distinct experts per tumbling window of w tokens, on average over whole windows.

    w <= 1, and a trace shorter than w, give top_k; no tokens at all give 0.
    """
    parts = []
    for w in widths:
        full = n_tokens // w if w > 1 else 0
        layers = wide.select("layer").distinct()
        if full == 0:
            parts.append(layers.select("layer", F.lit(w).alias("w"), F.lit(float(top_k if n_tokens else 0)).alias("mean_union")))
            continue
        sets = wide.where(F.col("token") < full * w).select("layer", F.floor(F.col("token") / w).alias("win"), F.explode("experts").alias("e"))
        sizes = sets.distinct().groupBy("layer", "win").agg(F.count(F.lit(1)).alias("u"))
        parts.append(sizes.groupBy("layer").agg((F.sum("u") / F.lit(full)).alias("mean_union")).select("layer", F.lit(w).alias("w"),
            F.least("mean_union", F.lit(float(n_experts))).alias("mean_union")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adjacent_overlap(wide: DataFrame) -> DataFrame:
    """(layer, reused, total, overlap): the share of selections that the token before made too. One join on (layer, token)."""
    before = wide.select("layer", (F.col("token") + 1).alias("token"), F.col("experts").alias("prev"))
    both = wide.join(before, ["layer", "token"]).select("layer", F.size(F.array_intersect("experts", "prev")).alias("hit"), F.size("experts").alias("k"))
    return both.groupBy("layer").agg(F.sum("hit").alias("reused"), F.sum("k").alias("total")).withColumn("overlap", F.col("reused") / F.col("total"))


def transitions(wide: DataFrame) -> DataFrame:
    """(layer, prev_expert, expert, n): how often an expert of the layer before goes with one of this layer, in a token."""
    prev = wide.select("token", (F.col("layer") + 1).alias("layer"), F.col("experts").alias("prev"))
    both = wide.join(prev, ["token", "layer"]).select("layer", F.explode("prev").alias("prev_expert"), "experts")
    return both.select("layer", "prev_expert", F.explode("experts").alias("expert")).groupBy("layer", "prev_expert", "expert").agg(F.count(F.lit(1)).alias("n"))


def speculative_gain(unions: DataFrame, alpha: float, top_k: int) -> DataFrame:
    """(layer, depth, accepted, per_accepted, gain, best): experts read per accepted token if a draft is checked in one pass.

    unions: window_union at the draft depths. The best depth of a layer reads least, ties to the smaller one.
    """
    accepted = F.least(F.lit(1.0) + F.aggregate(F.sequence(F.lit(1), F.col("w")), F.lit(0.0), lambda a, i: a + F.pow(F.lit(alpha), i.cast("double"))), F.col("w") + 1.0)
    rows = unions.select("layer", F.col("w").alias("depth"), accepted.alias("accepted"), (F.col("mean_union") / accepted).alias("per_accepted"))
    best = F.row_number().over(Window.partitionBy("layer").orderBy("per_accepted", "depth")) == 1
    return rows.withColumn("gain", F.lit(float(top_k)) / F.col("per_accepted")).withColumn("best", best)


def byte_entropy(data: DataFrame) -> DataFrame:
    """(key, n_bytes, entropy): bits per byte of binary `data` by `key`; no row for a key without bytes.

    Arrow batches are counted as they come, so at most 256 rows a key leave a batch.
    """
    import numpy as np
    import pyarrow as pa

    def count(batches):
        for b in batches:
            by: dict = {}
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw:
                    by[key] = by.get(key, 0) + np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            rows = [(k, int(v), int(c[v])) for k, c in by.items() for v in np.flatnonzero(c)]
            yield pa.record_batch([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                ["key", "byte", "c"])

    kind = data.schema["key"].dataType.simpleString()
    counts = data.select("key", "data").mapInArrow(count, f"key {kind}, byte int, c long").groupBy("key", "byte").agg(F.sum("c").alias("c"))
    total = counts.groupBy("key").agg(F.sum("c").alias("n_bytes"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("clogc"))
    return total.select("key", "n_bytes", (F.log2(F.col("n_bytes").cast("double")) - F.col("clogc") / F.col("n_bytes")).alias("entropy"))
