"""Command line over the engine: python -m routelake.cli COMMAND. Reports are tables on standard output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import advise, allocate, layout, model, predict, replay, stats
from .operators import surface as surfaces
from .sources import container, plan, store, synth
from .sources import trace as traces

MIB = 1 << 20


def _trace(spark, path):
    meta = traces.read_meta(path)
    return meta, stats_wide(traces.read(spark, path))


def stats_wide(trace):
    """Wide form that keeps the order of ranks."""
    return trace.groupBy("token", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "expert"))), lambda x: x["expert"]).alias("experts"))


def _surface(spark, path):
    if path:
        return surfaces.from_json(spark, path).drop("cache_bypassed")
    return spark.createDataFrame([], "cell_idx int, blob_bytes long, queue_depth int, bytes_per_sec double")


def cmd_probe(spark, a):
    surfaces.summary(_surface(spark, a.probe)).show(truncate=False)


def cmd_kio(spark, a):
    rows = spark.read.schema("engine string, qd int, dontcache boolean, gbps double").json(a.rows)
    surfaces.sorted_engines(rows).show(200, truncate=False)
    surfaces.engine_report(rows).show(truncate=False)


def cmd_predict(spark, a):
    meta, wide = _trace(spark, a.trace)
    budgets = [int(b) for b in a.budgets.split(",")] if a.budgets else [meta.top_k, 2 * meta.top_k, 4 * meta.top_k]
    predict.evaluate(wide, int(meta.n_tokens * a.fit), predict.KINDS, budgets).show(50, truncate=False)


def cmd_synth(spark, a):
    synth.checkpoint(a.out, a.layers, a.experts)
    c = synth.TraceConfig(a.layers, a.experts, a.top_k, a.tokens, a.clusters, a.locality, a.persistence, a.layer_coupling, a.prefill, a.prefill_locality)
    wide = synth.trace(spark, c)
    if not a.no_scatter:
        wide = synth.scatter(wide, a.experts, 0x5EED)
    traces.write(wide.select("token", "layer", F.posexplode("experts").alias("rnk", "expert")), a.trace, a.layers, a.experts, a.top_k, a.prefill)


def cmd_inspect(spark, a):
    container.files(spark, a.model).show(truncate=False)
    model.inspect(container.tensors(spark, a.model)).show(200, truncate=False)
    model.moe_skipped(container.tensors(spark, a.model)).show(200, truncate=False)


def cmd_fit(spark, a):
    c = container.parse(a.model)
    params = sum(__import__("math").prod(t.dims) for t in c.tensors)
    one = model.fit(spark.createDataFrame([(a.model, c.file_len - c.data_start, params, int(a.ram * (1 << 30)), a.ctx)], "model string, data_bytes long, params long, ram_bytes long, ctx long"))
    if a.json:
        print(one.toJSON().first())
        return
    one.show(truncate=False)
    if a.recommend_quant:
        t = model.fit_table(one)
        t.select("tier", "bpw", "weight_bytes", "tier_fits").show(truncate=False)
        model.recommend(t, ["model"]).show(truncate=False)


def cmd_compare(spark, a):
    done, skipped = model.compare(spark, a.a, a.b, a.tensor, a.limit)
    done.show(200, truncate=False)
    skipped.show(200, truncate=False)
    print("PASS" if model.passes(done) else "FAIL")


def _analysed(spark, a):
    """Per analysed block: (row of the model, searched order, cost before, cost after)."""
    meta, wide = _trace(spark, a.trace)
    surface = _surface(spark, a.probe)
    out = []
    for row in model.inspect(container.tensors(spark, a.model)).orderBy("block").collect():  # a row per block
        if row["trace_layer"] >= meta.n_layers:
            break
        one = wide.where(F.col("layer") == row["trace_layer"])
        found = layout.optimise(one, surface, row["n_experts"], row["slice_bytes"], len(row["expert_tensors"]), a.queue_depth, a.merge_gap)
        order = found.select("layer", "slot", "expert")
        shape = lambda lay: layout.cost(layout.shape(layout.slots_of(one, lay), a.merge_gap), surface, row["slice_bytes"], len(row["expert_tensors"]), a.queue_depth)  # noqa: B023, E731
        before, after = shape(layout.identity(row["n_experts"], one.select("layer").distinct())).head(), shape(order).head()
        out.append((row, [r["expert"] for r in order.orderBy("slot").collect()], before, after))
    return out


def cmd_analyse(spark, a):
    for row, _, before, after in _analysed(spark, a):
        gain = before["seconds_per_token"] / after["seconds_per_token"] if after["seconds_per_token"] else 1.0
        print(f"block {row['block']}: {before['requests_per_token']:.2f} -> {after['requests_per_token']:.2f} requests a token, {gain:.2f}x, {'worth repacking' if gain >= a.min_speedup else 'leave as it is'}")


def cmd_plan(spark, a):
    p = plan.Plan(a.model, a.trace)
    for row, order, before, after in _analysed(spark, a):
        gain = before["seconds_per_token"] / after["seconds_per_token"] if after["seconds_per_token"] else 1.0
        if gain >= a.min_speedup:
            p.layers.append(plan.Layer(row["block"], list(row["tensors"]), order, gain, before["requests_per_token"], after["requests_per_token"]))
    plan.write(p, a.out)
    print(p.text())


def cmd_pack(spark, a):
    print(model.repack(a.model, plan.read(a.plan), a.out))


def cmd_verify(spark, a):
    bad = model.verify(spark, a.model, a.repacked, plan.read(a.plan))
    n = bad.count()
    bad.show(truncate=False)
    print("identical up to the plan" if n == 0 else f"{n} slices differ")
    sys.exit(int(n > 0))


def cmd_build_store(spark, a):
    """Measures each expert's error by format, allocates bits, quantises, and writes the store."""
    from .functions import codec
    from .functions.scalars import NATIVE_TYPES, group_bytes, kind_of

    meta, wide = _trace(spark, a.trace)
    rows = model.inspect(container.tensors(spark, a.model)).orderBy("block").collect()
    freq = stats.frequency(wide.select("layer", F.explode("experts").alias("expert")), meta.n_experts)
    bps = surfaces.lookup(spark.createDataFrame([(2 * MIB, 8)], "blob_bytes long, queue_depth int"), _surface(spark, a.probe)).head()["bytes_per_sec"] or 2.4e9
    tags = {n: group_bytes(n) * 8 / 64 for n, *_ in NATIVE_TYPES}
    decode = codec.decode_slices
    slices = None
    for row in rows[: meta.n_layers]:
        first = decode(container.slices(spark, a.model).where(F.col("tensor") == row["expert_tensors"][0]), "values").select(F.col("slice").alias("key"), "values")
        bits = F.create_map(*[x for n, b in tags.items() for x in (F.lit(n), F.lit(b))])
        sens = codec.rmse_by_codec(first).select(F.lit(row["trace_layer"]).alias("layer"), F.col("key").cast("int").alias("expert"),
            F.lit(1).alias("ord"), bits[F.col("name")].alias("bits"), F.col("rmse").alias("error"))
        zero = spark.range(row["n_experts"]).select(F.lit(row["trace_layer"]).alias("layer"), F.col("id").cast("int").alias("expert"),
            F.lit(0).alias("ord"), F.lit(row["min_baseline_bits"]).alias("bits"), F.lit(0.0).alias("error"))
        config = allocate.Config(row["weights_per_expert"], (a.ram_mib * MIB) // len(rows), row["min_baseline_bits"], storage_bps=bps, error_budget=("uniform", a.error_bits), require_protection=False)
        chosen = allocate.allocate(freq.where(F.col("layer") == row["trace_layer"]), sens.unionByName(zero), meta.n_tokens, config)
        types = chosen.select(F.col("expert").alias("slice"), F.when(F.col("tier") == "resident", "Q8").otherwise(allocate.nearest_native(F.col("bits"))).alias("type"))
        one = decode(container.slices(spark, a.model).where(F.col("tensor").isin(*row["expert_tensors"])), "weights").join(types, "slice")
        one = one.select(F.lit(row["trace_layer"]).alias("layer"), F.col("slice").cast("int").alias("slot"), kind_of(F.col("tensor")).alias("kind"), "type", "weights")
        slices = one if slices is None else slices.unionByName(one)
    records = store.quantise(slices)
    store.write(records, a.out, a.group_align, a.group_experts)
    store.precision_mix(store.read(spark, a.out, payload=False)).show()


def cmd_bench(spark, a):
    meta, wide = _trace(spark, a.trace)
    sizes = store.spans(store.read(spark, a.store, payload=False)).select("layer", F.col("slot").alias("expert"), "bytes")
    surface = _surface(spark, a.probe)
    asked = sizes.select(F.col("bytes").alias("blob_bytes"), F.explode(F.array(F.lit(1), F.lit(a.queue_depth))).alias("queue_depth")).distinct()
    charged = surfaces.lookup(asked, surface).where("bytes_per_sec IS NOT NULL").select(F.col("blob_bytes").alias("bytes"), "queue_depth",
        surfaces.charge(F.col("blob_bytes"), F.col("bytes_per_sec")).alias("seconds"))
    if a.compare:
        configs = replay.sweep_configs(meta.top_k, a.cache_mib * MIB, a.queue_depth, a.budget)
    else:
        configs = [{"policy": a.policy, "predictor": None if a.predictor == "none" else a.predictor, "budget": a.budget, "cache_bytes": a.cache_mib * MIB, "queue_depth": a.queue_depth}]
    replay.run(wide, sizes, charged, int(meta.n_tokens * a.fit), configs).orderBy("config").show(50, truncate=False)


def cmd_advise(spark, a):
    layer = model.inspect(container.tensors(spark, a.model)).orderBy("block")
    n = layer.count()
    if not n:
        sys.exit("the model has no mixture layers")
    first = layer.limit(1).withColumn("n_layers", F.lit(n))
    name = first.head()["expert_tensors"][0]
    raw = container.slices(spark, a.model).where((F.col("tensor") == name) & (F.col("slice") == 0)).select(F.lit(0).alias("key"), "data")
    found = advise.model_findings(first, _surface(spark, a.probe), stats.byte_entropy(raw))
    if a.trace:
        meta, wide = _trace(spark, a.trace)
        found += advise.trace_findings(wide, first, meta.n_layers, meta.n_experts, meta.top_k, meta.n_tokens, a.cache_mib * MIB, a.acceptance,
            meta.prefill_tokens, _surface(spark, a.probe) if a.probe else None)
    else:
        found += advise.no_trace(spark)
    report = advise.ranked(found)
    report.show(truncate=False)
    advise.tally(report).show()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="routelake")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *args, alias=()):
        s = sub.add_parser(name, aliases=list(alias))
        for flags, kw in args:
            s.add_argument(*flags, **kw)
        s.set_defaults(run=f)

    o = lambda *flags, **kw: (flags, kw)
    m, t, pr = o("--model", required=True), o("--trace", required=True), o("--probe")
    lay = (m, t, pr, o("--merge-gap", type=int, default=0), o("--queue-depth", type=int, default=8), o("--min-speedup", type=float, default=1.05))
    add("probe", cmd_probe, o("--probe", required=True))
    add("kio", cmd_kio, o("--rows", required=True))
    add("predict", cmd_predict, t, o("--fit", type=float, default=0.5), o("--budgets"))
    add("build-store", cmd_build_store, m, t, pr, o("--out", required=True), o("--ram-mib", type=int, default=512),
        o("--group-align", type=int, default=2 * MIB), o("--group-experts", type=int, default=8), o("--error-bits", type=float, default=4.5))
    add("bench", cmd_bench, o("--store", required=True), t, pr, o("--cache-mib", type=int, default=64), o("--policy", default="gdsf"),
        o("--predictor", default="sticky+markov"), o("--budget", type=int, default=16), o("--queue-depth", type=int, default=8),
        o("--fit", type=float, default=0.5), o("--compare", action="store_true"))
    add("synth", cmd_synth, o("--out", required=True), t, o("--experts", type=int, default=32), o("--layers", type=int, default=2),
        o("--tokens", type=int, default=4000), o("--clusters", type=int, default=4), o("--locality", type=float, default=0.85),
        o("--persistence", type=float, default=0.7), o("--layer-coupling", type=float, default=0.45), o("--top-k", type=int, default=4),
        o("--prefill", type=int, default=0), o("--prefill-locality", type=float, default=0.05), o("--no-scatter", action="store_true"))
    add("inspect", cmd_inspect, m)
    add("fit", cmd_fit, m, o("--ram", type=float, required=True), o("--ctx", type=int, default=4096), o("--recommend-quant", action="store_true"), o("--json", action="store_true"))
    add("compare", cmd_compare, o("a"), o("b"), o("--tensor", default=""), o("--limit", type=int, default=12))
    add("analyse", cmd_analyse, *lay, alias=("analyze",))
    add("plan", cmd_plan, *lay, o("--out", default="model.plan"))
    add("pack", cmd_pack, m, o("--plan", required=True), o("--out", required=True))
    add("verify", cmd_verify, m, o("--repacked", required=True), o("--plan", required=True))
    add("advise", cmd_advise, m, o("--trace"), pr, o("--cache-mib", type=int, default=64), o("--acceptance", type=float, default=0.7))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("routelake").getOrCreate(), a)


if __name__ == "__main__":
    main()
