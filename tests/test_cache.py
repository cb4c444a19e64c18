"""Policies against published shares of the optimum, a plain emulation, and each other."""

import random

import pytest

from routelake.operators import cache
from routelake.sources.synth import Random


def skewed(n, ids, seed):
    r = Random(seed)
    return [int(r.unit() ** 3 * ids) for _ in range(n)]


@pytest.mark.parametrize(("policy", "share"), [("lru", 0.8087), ("lfu", 0.7843), ("gdsf", 0.9070), ("slru", 0.8967)])
def test_share_of_optimum(policy, share):
    log = skewed(20_000, 128, 9)
    c = cache.Cache(32_000, policy)
    for k in log:
        c.access((0, k), 1000, 1.0)
    counts = sorted((log.count(k) for k in set(log)), reverse=True)
    assert c.stats.hit_rate / (sum(counts[:32]) / len(log)) == pytest.approx(share, abs=5e-4)


def test_mixed_costs():
    r = Random(9)
    log = [int(r.unit() ** 3 * 128) for _ in range(20_000)]
    out = {}
    for policy in ("lru", "lfu", "gdsf"):
        c = cache.Cache(40_000, policy)
        for k in log:
            c.access((0, k), 1000 if k % 2 == 0 else 4000, 1.0 if k % 2 == 0 else 8.0)
        out[policy] = c.stats
    assert out["gdsf"].fetch_seconds < min(out["lru"].fetch_seconds, out["lfu"].fetch_seconds)
    assert out["gdsf"].hit_rate < out["lfu"].hit_rate


def test_lru_is_a_plain_lru(spark):
    log = skewed(5000, 64, 3)
    df = spark.createDataFrame(list(enumerate(log)), "seq long, key long")
    configs = spark.createDataFrame([("lru", s, 0.8) for s in (4, 16)], "policy string, capacity long, protected_share double")
    from pyspark.sql import functions as F

    sim = {r["capacity"]: r["hits"] for r in cache.simulate(df.select("seq", "key", F.lit(1).alias("bytes"), F.lit(1.0).alias("cost")), configs).collect()}
    dist = {r["slots"]: r["hits"] for r in cache.lru_hits(df.limit(5000), [4, 16]).collect()}
    assert sim == dist


def test_pins_prefetch_and_size():
    c = cache.Cache(2, "lru")
    assert not c.access("a", 3, 1.0) and "a" not in c
    assert c.pin("a", 1) and c.prefetch("b", 1, 1.0) and not c.prefetch("b", 1, 1.0)
    assert c.stats.misses == 1
    c.access("c", 1, 1.0)
    assert "a" in c and "b" not in c
    c.unpin("a")
    c.access("d", 1, 1.0)
    assert "a" not in c and c.used == 2
    with pytest.raises(ValueError):
        cache.Cache(1, "fifo")


def test_segments_protect_against_a_sweep():
    def run(policy, share=0.8):
        c = cache.Cache(16, policy, share)
        for _ in range(2):
            for k in range(8):
                c.access(k, 1, 1.0)
        for k in range(100, 164):
            c.access(k, 1, 1.0)
        before = c.stats.hits
        for k in range(8):
            c.access(k, 1, 1.0)
        return c.stats.hits - before

    assert run("lru") == 0 and run("slru") == 8


def test_stream_equals_batch(spark, tmp_path):
    from routelake.streaming import lru

    log = skewed(600, 40, 7)
    rows = [("x", i, k) for i, k in enumerate(log)] + [("y", i, k % 5) for i, k in enumerate(log)]
    src = tmp_path / "in"
    for part in (rows[:500], rows[500:]):
        spark.createDataFrame(part, "cache string, seq long, key long").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("cache string, seq long, key long").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = lru.lru_stream(stream, 8).writeStream.outputMode("update").format("memory").queryName("lru_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["cache"]: r["hits"] for r in spark.sql("SELECT cache, max(hits) AS hits FROM lru_out GROUP BY cache").collect()}
    for name in ("x", "y"):
        c = cache.Cache(8, "lru")
        for n, _, k in rows:
            if n == name:
                c.access(k, 1, 1.0)
        assert got[name] == c.stats.hits


def test_reuse_distances_in_blocks(spark):
    rng = random.Random(21)
    keys = [rng.choice([1, 1, 1, *range(30)]) for _ in range(400)]
    log = spark.createDataFrame(list(enumerate(keys)), "seq long, key long")
    want = {}
    for s, k in enumerate(keys):
        before = [i for i in range(s) if keys[i] == k]
        want[s] = (before[-1], len(set(keys[before[-1] + 1 : s]))) if before else (None, None)
    for block in (7, 100, 1000):
        got = {r["seq"]: (r["prev_seq"], r["distance"]) for r in cache.reuse_distance(log, block).collect()}
        assert got == want
    assert cache.reuse_distance(log.where("false")).count() == 0
