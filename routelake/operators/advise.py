"""What is worth doing for a model on a device: one numeric finding per check, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cache, stats
from . import surface as surfaces
from .model import PLATEAU

#: Order of verdicts in a report.
RANK = {"HAZARD": 0, "DO": 1, "MARGINAL": 2, "UNKNOWN": 3, "SKIP": 4}
FLOOR_BITS, ENTROPY_SAVING, PRUNE_SHARE = 2.5, 0.10, 0.05


def classify(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, "DO").when(ratio >= 1.15, "MARGINAL").otherwise("SKIP")


def finding(df: DataFrame, idx: int, topic: str, metric: Column, baseline: Column, verdict: Column, ratio: Column | None = None) -> DataFrame:
    base = df.select(F.lit(idx).alias("idx"), F.lit(topic).alias("topic"), metric.cast("double").alias("metric"),
        baseline.cast("double").alias("baseline"), verdict.alias("verdict"),
        (ratio if ratio is not None else metric / baseline).cast("double").alias("ratio"))
    return base


def ranked(findings: list[DataFrame]) -> DataFrame:
    """All findings with their rank; within a rank they keep the order of the checks."""
    both = reduce(DataFrame.unionByName, findings)
    order = reduce(lambda c, v: c.when(F.col("verdict") == v, RANK[v]), list(RANK)[1:], F.when(F.col("verdict") == "HAZARD", 0))
    return both.withColumn("rank", order).orderBy("rank", "idx").select("rank", "idx", "verdict", "topic", "metric", "baseline", "ratio")


def tally(findings: DataFrame) -> DataFrame:
    return findings.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def model_findings(layer: DataFrame, surface: DataFrame, entropy: DataFrame | None = None) -> list[DataFrame]:
    """Checks that need no trace. layer: one row of moe_layers with n_layers; entropy: one row (entropy)."""
    s = layer.withColumn("blob_bytes", F.greatest("slice_bytes", F.lit(4096)).cast("long"))
    at = lambda q, name: surfaces.lookup(s.select("blob_bytes", F.lit(q).alias("queue_depth")), surface).select(F.col("bytes_per_sec").alias(name))
    one = at(1, "q1").join(F.broadcast(at(16, "q16")))  # one row each
    ratio = F.when(F.col("q1") > 0, F.col("q16") / F.col("q1")).otherwise(F.lit(0.0))
    out = [finding(one, 0, "queue depth", F.col("q16"), F.col("q1"), F.when(F.col("q1").isNull(), "UNKNOWN").when(ratio > 1.5, "DO").otherwise("SKIP"), ratio)]
    size = F.col("slice_bytes") / F.lit(float(PLATEAU))
    out.append(finding(layer, 1, "expert layout", F.col("slice_bytes"), F.lit(float(PLATEAU)), F.when(size < 1, "DO").when(size < 1.5, "MARGINAL").otherwise("SKIP"), size))
    head = F.col("min_baseline_bits") - FLOOR_BITS
    out.append(finding(layer, 2, "precision", F.col("min_baseline_bits"), F.lit(FLOOR_BITS), F.when(head > 1, "DO").otherwise("SKIP")))
    if entropy is None:
        out.append(finding(layer, 3, "lossless coding", F.lit(None), F.lit(8.0), F.lit("UNKNOWN")))
    else:
        saving = 1 - F.col("entropy") / 8
        out.append(finding(entropy, 3, "lossless coding", F.col("entropy"), F.lit(8.0), F.when(saving > ENTROPY_SAVING, "DO").otherwise("SKIP"), saving))
    row = F.floor(F.col("slice_bytes") / F.sqrt(F.greatest("weights_per_expert", F.lit(1)).cast("double")))
    out.append(finding(layer, 4, "activation sparsity", F.greatest(row, F.lit(1)), F.lit(float(PLATEAU)), F.lit("SKIP")))
    out.append(finding(layer, 5, "outlier experts", F.col("n_experts") * F.col("n_layers"), F.lit(0.005), F.lit("HAZARD"), F.lit(None).cast("double")))
    return out


def trace_findings(wide: DataFrame, layer: DataFrame, n_layers: int, n_experts: int, top_k: int, n_tokens: int, cache_bytes: int, alpha: float,
    prefill: int = 0, surface: DataFrame | None = None) -> list[DataFrame]:
    """Checks on a trace's first layer, and on all of it for the cache. layer: one row (bytes_per_expert, slice_bytes)."""
    first = wide.where("layer = 0")
    spark: SparkSession = wide.sparkSession
    bytes_per_expert, slice_bytes = layer.select("bytes_per_expert", "slice_bytes").head()  # one row
    resident = max(1, min(n_experts, cache_bytes // max(1, bytes_per_expert)))
    freq = stats.frequency(first.select("layer", F.explode("experts").alias("expert")))
    mass = stats.mass_in_top(freq, [resident])
    uniform = F.lit(resident / n_experts)
    out = [finding(mass, 6, "expert cache", F.col("mass"), uniform, classify(F.col("mass") / uniform))]
    gains = stats.speculative_gain(stats.window_union(first, [2, 4, 8], n_tokens, top_k, n_experts), alpha, top_k).where("best")
    out.append(finding(gains, 7, "speculative decoding", F.lit(float(top_k)), F.col("per_accepted"), classify(F.col("gain")), F.col("gain")))
    unused = stats.never_selected(first.select("layer", F.explode("experts").alias("expert")), n_experts).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.lit(float(n_experts))
    out.append(finding(unused, 8, "expert pruning", F.col("n"), F.lit(float(n_experts)), F.when(share > PRUNE_SHARE, "MARGINAL").otherwise("SKIP")))
    if prefill:
        log = wide.select("token", "layer", F.posexplode("experts").alias("r", "expert"))
        seq = F.col("token") * (n_layers * top_k) + F.col("layer") * top_k + F.col("r")
        cost = 1.0
        if surface is not None:
            bw = surfaces.lookup(spark.createDataFrame([(max(slice_bytes, 4096), 16)], "blob_bytes long, queue_depth int"), surface).head()["bytes_per_sec"]
            cost = bytes_per_expert / bw if bw else 1.0
        log = log.select(seq.alias("seq"), (F.col("layer") * n_experts + F.col("expert")).alias("key"), F.lit(bytes_per_expert).cast("long").alias("bytes"), F.lit(cost).alias("cost"))
        grid = spark.createDataFrame([("lru", cache_bytes, cache.PROTECTED), ("slru", cache_bytes, cache.PROTECTED)], "policy string, capacity long, protected_share double")
        rates = cache.simulate(log, grid, count_from=prefill * n_layers * top_k)
        one = rates.agg(F.max(F.when(F.col("policy") == "slru", F.col("hit_rate"))).alias("s"), F.max(F.when(F.col("policy") == "lru", F.col("hit_rate"))).alias("l"))
        gain = F.col("s") - F.col("l")
        out.append(finding(one, 9, "segmented cache", F.col("s"), F.col("l"), F.when(gain > 0.05, "DO").when(gain > 0.01, "MARGINAL").otherwise("SKIP"), gain))
    else:
        out.append(finding(spark.range(1), 9, "segmented cache", F.lit(None), F.lit(None), F.lit("UNKNOWN"), F.lit(None).cast("double")))
    chance = F.lit(top_k / n_experts)
    overlap = stats.adjacent_overlap(wide).agg((F.sum("reused") / F.sum("total")).alias("o"))
    out.append(finding(overlap, 10, "prefetch", F.col("o"), chance, classify(F.col("o") / chance)))
    return out


def no_trace(spark: SparkSession) -> list[DataFrame]:
    return [finding(spark.range(1), 6, "cache and prefetch", F.lit(None), F.lit(None), F.lit("UNKNOWN"), F.lit(None).cast("double"))]
