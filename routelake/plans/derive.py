"""Routing data derived from general tables, as narrow transformations wherever the row holds all that is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS, EXPERTS, TOP_K = 4, 16, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, layer, experts): each 16 values of an embedding are a layer's router logits, its four largest the choice.

    Ranking happens inside the row, so there is no shuffle.
    """
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), "embedding")
    layers = F.transform(
        F.sequence(F.lit(0), F.lit(LAYERS - 1)),
        lambda l: F.struct(
            l.alias("layer"),
            F.transform(
                F.slice(
                    F.array_sort(F.transform(F.slice(F.col("embedding"), l * EXPERTS + 1, F.lit(EXPERTS)), lambda v, i: F.struct((-v).alias("v"), i.alias("e")))),
                    1,
                    TOP_K,
                ),
                lambda x: x["e"],
            ).alias("experts"),
        ),
    )
    return emb.select("token", F.inline(layers)).select("token", "layer", "experts")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, layer, rnk, expert) of the same."""
    return trace_wide(spark, sf_dir).select("token", "layer", F.posexplode("experts").alias("rnk", "expert"))


def ragged_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, layer, expert) from order lines: an order's suppliers, each once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), F.lit(0).alias("layer"), F.col("l_suppkey").alias("expert")).distinct()


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, key): events in order of time, by user.

    Ranges of (ts, event_id) are sorted apart and written once; a row's seq is its place in its range after the counts of
    the ranges before, so no task sorts the whole log.
    """
    from pyspark.sql import Window

    from ..sources import scratch

    path = scratch(spark, "log")
    ranged = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("key")).repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
    ranged.select("key", F.monotonically_increasing_id().alias("place")).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("range", F.shiftright("place", 33))
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = counts.select("range", F.coalesce(before, F.lit(0)).alias("start"))
    seq = F.col("start") + F.col("place") - F.shiftleft("range", 33)
    return placed.join(F.broadcast(starts), "range").select(seq.alias("seq"), "key")


#: A published bandwidth surface, GB/s by request size and queue depth.
SURFACE_GBPS = {
    64 * 1024: {1: 0.12, 4: 0.41, 8: 0.82, 16: 1.36},
    256 * 1024: {1: 0.26, 4: 1.24, 8: 2.15, 16: 2.02},
    1024 * 1024: {1: 0.64, 4: 1.70, 8: 2.21, 16: 2.40},
    2048 * 1024: {1: 0.79, 4: 2.10, 8: 2.41, 16: 2.34},
}


def surface_cells() -> list[tuple[int, int, int, float]]:
    cells = [(b, q, v * 1e9) for b, by in SURFACE_GBPS.items() for q, v in by.items()]
    return [(i, *c) for i, c in enumerate(cells)]


def surface(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(surface_cells(), "cell_idx int, blob_bytes long, queue_depth int, bytes_per_sec double")
