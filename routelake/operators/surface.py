"""Measured device bandwidth as a table: nearest-cell lookup, charges, and reports over ingested measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a surface that may be sent to all tasks; a surface has a cell per size and depth.
MOST_CELLS = 4096


def bounded(surface: DataFrame) -> DataFrame:
    """The surface with a broadcast hint, after its size was checked."""
    if len(surface.limit(MOST_CELLS + 1).select("cell_idx").collect()) > MOST_CELLS:
        raise ValueError(f"a surface has at most {MOST_CELLS} cells")
    return F.broadcast(surface)


def lookup(asked: DataFrame, surface: DataFrame) -> DataFrame:
    """asked (blob_bytes, queue_depth, ...) with bytes_per_sec of the nearest cell; null if the surface is empty.

    Nearness: |ln size ratio| + |ln depth ratio|; the first cell wins ties. Each distinct (size, depth) meets the cells
    once, as an array that is folded inside the row, and rows get the answer by a join.
    """
    cells = surface.groupBy().agg(F.sort_array(F.collect_list(F.struct("cell_idx", F.col("blob_bytes").alias("b"), F.col("queue_depth").alias("q"), F.col("bytes_per_sec").alias("v")))).alias("cells"))
    keys = asked.select("blob_bytes", "queue_depth").distinct()
    dist = lambda c: F.abs(F.log(F.col("blob_bytes") / c["b"])) + F.abs(F.log(F.col("queue_depth") / c["q"]))
    best = F.aggregate(
        "cells",
        F.struct(F.lit(float("inf")).alias("d"), F.lit(None).cast("double").alias("v")),
        lambda a, c: F.when(dist(c) < a["d"], F.struct(dist(c).alias("d"), c["v"].alias("v"))).otherwise(a),
        lambda a: a["v"],
    )
    answered = keys.join(F.broadcast(cells)).select("blob_bytes", "queue_depth", best.alias("bytes_per_sec"))  # cells: one row
    return asked.join(answered, ["blob_bytes", "queue_depth"], "left")


def charge(n_bytes: Column, bytes_per_sec: Column) -> Column:
    """Seconds to move bytes; 1 where there is no measurement."""
    return F.when(bytes_per_sec > 0, n_bytes / bytes_per_sec).otherwise(F.lit(1.0))


def summary(surface: DataFrame) -> DataFrame:
    """peak, worst (bytes/s), spread (peak / worst), and the cell of the peak."""
    peak = F.max_by(F.struct("blob_bytes", "queue_depth"), F.struct("bytes_per_sec", (-F.col("cell_idx")).alias("i")))
    return surface.agg(F.max("bytes_per_sec").alias("peak"), F.min("bytes_per_sec").alias("worst"), peak.alias("p")).select("peak", "worst",
        (F.col("peak") / F.col("worst")).alias("spread"), F.col("p.blob_bytes").alias("peak_blob_bytes"),
        F.col("p.queue_depth").alias("peak_queue_depth"))


def from_json(spark, path: str) -> DataFrame:
    """A surface written as one JSON object with a list of cells; an absent cache_bypassed means true."""
    raw = spark.read.schema("note string, cache_bypassed boolean, cells array<struct<blob_bytes:bigint,queue_depth:int,bytes_per_sec:double>>").json(path, multiLine=True)
    return raw.select(F.coalesce("cache_bypassed", F.lit(True)).alias("cache_bypassed"),
        F.posexplode("cells").alias("cell_idx", "c")).select("cell_idx", "c.blob_bytes", "c.queue_depth", "c.bytes_per_sec", "cache_bypassed")


def to_json(surface: DataFrame, path: str, note: str = "", cache_bypassed: bool = True) -> None:
    cells = F.sort_array(F.collect_list(F.struct("cell_idx", "blob_bytes", "queue_depth", "bytes_per_sec")))
    one = surface.agg(cells.alias("c")).select(F.lit(note).alias("note"), F.lit(cache_bypassed).alias("cache_bypassed"),
        F.transform("c", lambda x: F.struct(x["blob_bytes"].alias("blob_bytes"), x["queue_depth"].alias("queue_depth"), x["bytes_per_sec"].alias("bytes_per_sec"))).alias("cells"))
    one.coalesce(1).write.mode("overwrite").json(path)


def engine_report(rows: DataFrame) -> DataFrame:
    """(metric, qd, value) over measured I/O engines (engine, qd, dontcache, gbps).

    best / base: the best rate and the pread rate; gain: their ratio; batch_vs_stream and threads_vs_uring: percent by
    which the second is above the first at equal depth; dontcache: percent at depth 16; recommend: 1 threads, -1
    uring-stream, 0 within 5 %.
    """
    at = lambda engine, dc=False: F.max(F.when((F.col("engine") == engine) & (F.col("dontcache") == dc), F.col("gbps")))
    by_depth = rows.groupBy("qd").agg(at("uring-batch").alias("batch"), at("uring-stream").alias("stream"), at("threads").alias("threads"), at("uring-stream", True).alias("dc"))
    floor = lambda c: F.greatest(c, F.lit(1e-9))
    percent = by_depth.select(
        "qd",
        F.inline(
            F.array(
                F.struct(F.lit("batch_vs_stream").alias("metric"), F.when(F.col("qd").isin(8, 16, 32), (F.col("stream") / floor(F.col("batch")) - 1) * 100).alias("value")),
                F.struct(F.lit("threads_vs_uring").alias("metric"), F.when(F.col("qd").isin(8, 16), (F.col("stream") / floor(F.col("threads")) - 1) * 100).alias("value")),
                F.struct(F.lit("dontcache").alias("metric"), F.when(F.col("qd") == 16, (F.col("dc") / floor(F.col("stream")) - 1) * 100).alias("value")),
            )
        ),
    ).where("value IS NOT NULL")
    one = rows.agg(F.max("gbps").alias("best"), F.coalesce(F.max(F.when(F.col("engine") == "pread", F.col("gbps"))), F.lit(0.0)).alias("base"), at("threads").alias("t"), at("uring-stream").alias("u"))
    recommend = F.when(F.col("t") > F.col("u") * 1.05, 1.0).when(F.col("u") > F.col("t") * 1.05, -1.0).when(F.col("t").isNotNull() & F.col("u").isNotNull(), 0.0)
    whole = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n,
        c in (("best", F.col("best")), ("base", F.col("base")), ("gain", F.col("best") / floor(F.col("base"))), ("recommend", recommend))])))
    return whole.select("metric", F.lit(None).cast("int").alias("qd"), "value").unionByName(percent.select("metric", "qd", "value"))


def sorted_engines(rows: DataFrame) -> DataFrame:
    return rows.orderBy("engine", "dontcache", "qd")


def residency(rows: DataFrame) -> DataFrame:
    """Ingested page-cache counters (cached, dirty, writeback, evicted, recently_evicted, pages) -> cached_fraction, thrashing."""
    return rows.withColumn("cached_fraction", F.when(F.col("pages") > 0, F.col("cached") / F.col("pages")).otherwise(F.lit(0.0))).withColumn("thrashing", F.col("recently_evicted") > 0)


def first_best(df: DataFrame, by: list[str], value: str, tie: list[str], largest: bool = True) -> DataFrame:
    """The best row of each group, ties by the given columns."""
    order = Window.partitionBy(*by).orderBy(F.desc(value) if largest else F.asc(value), *tie)
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
