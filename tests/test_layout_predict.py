import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.operators import allocate, layout, predict, replay, stats
from routelake.operators import surface as surfaces
from routelake.plans import derive
from routelake.sources import synth


def wide(spark, **kw):
    c = synth.TraceConfig(**kw)
    return synth.trace(spark, c), c


def test_search_finds_scattered_clusters_and_leaves_noise(spark):
    good, _ = wide(spark, n_layers=1, n_experts=32, top_k=4, n_tokens=1500, clusters=4, locality=0.95, persistence=0.0, layer_coupling=0.0, seed=21)
    good = good.withColumn("experts", F.transform("experts", lambda e: ((e % 4) * 8 + F.floor(e / 4)).cast("int")))
    rows = layout.optimise(good, derive.surface(spark), 32, 65536).collect()
    assert sorted(r["expert"] for r in rows) == list(range(32))
    assert rows[0]["seconds_after"] < rows[0]["seconds_before"]
    noise, _ = wide(spark, n_layers=1, n_experts=32, top_k=4, n_tokens=800, clusters=1, locality=0.0, persistence=0.0, layer_coupling=0.0, seed=5)
    r = layout.optimise(noise, derive.surface(spark), 32, 65536, passes=1).head()
    assert r["seconds_before"] / r["seconds_after"] < 1.2


def test_costing_agrees_with_sql(spark):
    t, _ = wide(spark, n_layers=1, n_tokens=300)
    lay = layout.identity(32, t.select("layer").distinct())
    for gap in (0, 2):
        a = layout.cost(layout.shape(layout.slots_of(t, lay), gap), derive.surface(spark), 65536, 3, 8).head()["seconds_per_token"]
        ids = np.array([r["experts"] for r in t.collect()])
        b = layout.Costing(ids, np.ones(len(ids), int), derive.surface_cells(), 65536, 3, 8, gap).mean(np.arange(32))
        assert a == pytest.approx(b)
    empty = derive.surface(spark).where("false")
    c = layout.cost(layout.shape(layout.slots_of(t, lay), 0), empty, 65536, 3, 8).head()
    assert c["seconds_per_token"] == c["requests_per_token"]


def test_runs_and_gaps(spark):
    one = spark.createDataFrame([(0, 0, [0, 1, 2, 3]), (1, 0, [0, 2]), (2, 0, [5, 5])], "token long, layer int, slots array<int>").withColumn("slots", F.array_sort(F.array_distinct("slots")))
    assert [(r["runs"], r["span"]) for r in layout.shape(one).orderBy("token").collect()] == [(1, 4), (2, 2), (1, 1)]
    assert [(r["runs"], r["span"]) for r in layout.shape(one, 1).orderBy("token").collect()] == [(1, 4), (1, 3), (1, 1)]


def test_permutations_are_checked(spark):
    bad = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "layer int, slot int, expert int")
    assert layout.check_permutation(bad, 2).count() == 1
    assert layout.check_permutation(layout.identity(4, spark.range(1).selectExpr("cast(id AS int) AS layer")), 4).count() == 0


def test_greedy_order_ties():
    assert layout.greedy_order(4, {}) == [0, 1, 2, 3]
    assert layout.greedy_order(4, {(1, 3): 5, (0, 2): 5})[:2] == [0, 2]


def test_predictors(spark):
    t, c = wide(spark, n_layers=3, n_experts=64, top_k=6, n_tokens=700, clusters=8, locality=0.9, persistence=0.7, layer_coupling=0.5, seed=11)
    rows = {(r["kind"], r["budget"]): r for r in predict.evaluate(t, 350, predict.KINDS, [6, 12, 24]).collect()}
    for kind in predict.KINDS:
        recalls = [rows[kind, b]["recall"] for b in (6, 12, 24)]
        assert recalls == sorted(recalls)
    assert rows["sticky", 6]["recall"] > rows["frequency", 6]["recall"]
    assert rows["sticky+markov", 24]["recall"] >= rows["sticky", 24]["recall"]
    assert rows["sticky+markov", 6]["recall"] == pytest.approx(rows["sticky", 6]["recall"])
    assert predict.score(predict.predictions(t, 700, "sticky", 6)).head()["recall"] is None
    long = predict.predictions(t, 350, "frequency", 6).count()
    hot, _ = predict.fit(t, 350)
    first = t.where("token >= 350").select("token", "layer", F.posexplode("experts").alias("pos", "expert")).where("pos < 2")
    assert predict.pad(first, hot, 6).groupBy("token", "layer").count().where("count = 6").count() == long


def test_reuse_grows_with_persistence(spark):
    share = []
    for p in (0.0, 0.9):
        t, _ = wide(spark, n_layers=1, n_experts=64, top_k=8, n_tokens=800, persistence=p, layer_coupling=0.0, seed=19)
        share.append(stats.adjacent_overlap(t).head()["overlap"])
    assert share[1] > 1.8 * share[0]


def test_relabelling_keeps_counts(spark):
    t, _ = wide(spark, n_layers=1, n_tokens=200)
    counts = lambda x: sorted(r["n"] for r in stats.coactivation(x).collect())
    assert counts(t) == counts(synth.scatter(t, 32, 0x5EED))
    assert sorted(synth.relabelling(32, 1)) == list(range(32))


def test_bigger_caches_read_less(spark):
    t, _ = wide(spark, n_layers=2, n_experts=32, top_k=4, n_tokens=400, clusters=8, locality=0.9, seed=3)
    sizes = spark.createDataFrame([(layer, e, 1000) for layer in range(2) for e in range(32)], "layer int, expert int, bytes long")
    none = spark.createDataFrame([], "bytes long, queue_depth int, seconds double")
    configs = [{"policy": "gdsf", "predictor": k, "budget": 4, "cache_bytes": b, "queue_depth": 8} for k in (None, "sticky") for b in (4000, 16000, 64000)]
    rows = sorted(replay.run(t, sizes, none, 200, configs).collect(), key=lambda r: r["config"])
    assert [r["tokens"] for r in rows] == [200] * 6 and not rows[0]["calibrated"]
    for part in (rows[:3], rows[3:]):
        moved = [r["bytes_per_token"] for r in part]
        assert moved == sorted(moved, reverse=True)
    assert rows[0]["useful"] == 0 and rows[3]["useful"] > 0
    assert all(r["hits"] + r["misses"] == 200 * 2 * 4 for r in rows)


def test_allocation_guard_and_budget(spark):
    freq = np.arange(16)[::-1] * 10
    error = lambda e, b: {8.25: 0.0, 4.5: 0.001, 2.5: 0.002}[min((8.25, 4.5, 2.5), key=lambda x: abs(x - b))]
    c = allocate.Config(4096, 4 * 4224, 8.25, error_budget=("uniform", 4.5))
    rows, s = allocate.plan_layer(freq, 100, error, c)
    assert s["speedup"] == 1.0 and {r["label"] for r in rows} == {"keep"}
    free = allocate.Config(4096, 4 * 4224, 8.25, error_budget=("uniform", 4.5), require_protection=False)
    rows, s = allocate.plan_layer(freq, 100, error, free)
    assert s["speedup"] > 1 and sum(r["tier"] == "resident" for r in rows) == 4
    assert rows[15]["bits"] == min(r["bits"] for r in rows)  # never selected: the lowest rung
    looser = allocate.Config(4096, 4 * 4224, 8.25, error_budget=("absolute", 1.0), require_protection=False)
    assert allocate.plan_layer(freq, 100, error, looser)[1]["speedup"] >= s["speedup"]
    kept = allocate.Config(4096, 4 * 4224, 8.25, error_budget=("absolute", 1.0), protected=frozenset({15}))
    assert allocate.plan_layer(freq, 100, error, kept)[0][15]["label"] == "keep"
    none = allocate.Config(4096, 0, 8.25, ladder=allocate.LADDER[2:3], error_budget=("relative", 2.0), require_protection=False)  # twice nothing
    assert allocate.plan_layer(freq[:4] + 1, 100, error, none)[1]["speedup"] == 1.0
    near = spark.range(1).select(*[allocate.nearest_native(F.lit(b)) for b in (4.4, 16.0)])
    assert tuple(near.head()) == ("Q4", "Q8")


def test_surface_json(spark, tmp_path):
    surfaces.to_json(derive.surface(spark), str(tmp_path / "s"), "a note")
    back = surfaces.from_json(spark, str(tmp_path / "s"))
    assert back.count() == 16 and back.where("cache_bypassed").count() == 16
    asked = spark.createDataFrame([(2097152, 8)], "blob_bytes long, queue_depth int")
    assert surfaces.lookup(asked, back).head()["bytes_per_sec"] == 2.41e9
    assert surfaces.lookup(asked, back.where("false")).head()["bytes_per_sec"] is None
