"""What a container's tensors say: mixture layers, what they weigh, whether they fit, how two files agree, repacking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.scalars import DECODABLE, QUANT_TIERS, tensor_bytes
from ..sources import container, put_file
from ..sources.plan import Plan

#: Parts of tensor names that carry the expert axis, and those of routers.
EXPERT_PARTS = ("ffn_gate_exps", "ffn_up_exps", "ffn_down_exps", "ffn_gate_exps_b", "ffn_up_exps_b", "ffn_down_exps_b")
ROUTER_PARTS = ("ffn_gate_inp", "exp_probs_b")
#: Bytes kept for a context (base, per token), and the share of memory that may be used.
RESERVE_BASE, RESERVE_TOKEN, USABLE = 400 << 20, 128 << 10, 0.95
#: Fixed value: above this slice size request size no longer matters.
PLATEAU = 256 * 1024


def _contains(name: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def _tagged(tensors: DataFrame) -> DataFrame:
    """Expert-axis tensors with block, last dim, whether they are experts, and why they can't be used (null if they can)."""
    t = tensor_bytes(tensors)
    t = t.withColumn("is_expert", _contains(F.col("name"), EXPERT_PARTS)).where(F.col("is_expert") | _contains(F.col("name"), ROUTER_PARTS))
    block = F.regexp_extract("name", r"^blk\.(\d+)\.", 1)
    t = t.withColumn("block", F.when(block != "", block.cast("int"))).withColumn("last", F.coalesce(F.element_at("dims", -1), F.lit(0)))
    per = t.where("block IS NOT NULL").groupBy("block").agg(F.max("last").alias("n_experts"), F.max("is_expert").alias("any_expert"))
    t = t.join(F.broadcast(per), "block", "left")  # a row per block
    reason = (
        F.when(F.col("block").isNull(), "no block")
        .when(~F.col("any_expert"), None)
        .when(F.col("last") != F.col("n_experts"), "expert count differs")
        .when((F.col("n_experts") == 0) | (F.col("nbytes") % F.col("n_experts") != 0), "slices are not whole")
    )
    return t.withColumn("reason", reason)


def moe_skipped(tensors: DataFrame) -> DataFrame:
    """(name, reason) of expert-axis tensors that can't be permuted."""
    return _tagged(tensors).where("reason IS NOT NULL").select("name", "reason")


def moe_layers(tensors: DataFrame) -> DataFrame:
    """A row per block whose expert-axis tensors all agree: n_experts, tensors, expert_tensors, bytes_per_expert,
    slice_bytes, weights_per_expert, baseline_bits (size-weighted), min_baseline_bits, baseline_type (of the largest)."""
    t = _tagged(tensors).where("block IS NOT NULL AND any_expert")
    e = F.col("is_expert")
    only = lambda c: F.when(e, c)
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("idx", "name")))), lambda x: x["name"])
    g = t.groupBy("block", "n_experts").agg(
        F.max(F.col("reason").isNotNull()).alias("bad"),
        names(F.lit(True)).alias("tensors"),
        names(e).alias("expert_tensors"),
        F.sum(only(F.expr("nbytes div n_experts"))).alias("bytes_per_expert"),
        F.max(only(F.expr("nbytes div n_experts"))).alias("slice_bytes"),
        F.sum(only(F.expr("n_elements div n_experts"))).alias("weights_per_expert"),
        (F.sum(only(F.col("nbytes"))) * 8.0 / F.sum(only(F.col("n_elements")))).alias("baseline_bits"),
        F.min(only(F.col("bits_per_weight"))).alias("min_baseline_bits"),
        F.max_by("type_name", F.when(e, F.struct("nbytes", (-F.col("idx")).alias("i")))).alias("baseline_type"),
    )
    return g.where("NOT bad").drop("bad")


def inspect(tensors: DataFrame) -> DataFrame:
    """moe_layers in order of block, with the place of the trace layer that each stands for."""
    from pyspark.sql import Window

    return moe_layers(tensors).withColumn("trace_layer", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("block")) - 1).cast("int"))  # a row per block


def fit(models: DataFrame) -> DataFrame:
    """models (data_bytes, ram_bytes, ctx, ...) with reserve, projected, ceiling, fits, max_weights."""
    reserve = F.lit(RESERVE_BASE) + F.col("ctx") * RESERVE_TOKEN
    df = models.withColumn("reserve", reserve.cast("long")).withColumn("projected", F.col("data_bytes") + F.col("reserve")).withColumn("ceiling",
        F.floor(F.col("ram_bytes") * F.lit(USABLE)).cast("long"))
    return df.withColumn("fits", (F.col("ram_bytes") > 0) & (F.col("projected") <= F.col("ceiling"))).withColumn("max_weights", F.greatest(F.lit(0), F.col("ceiling") - F.col("reserve")))


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(QUANT_TIERS)], "ord int, tier string, bpw double")


def fit_table(models: DataFrame) -> DataFrame:
    """models (params, max_weights, ...) by quantisation tier: weight_bytes, tier_fits."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("tier"), F.lit(b).alias("bpw")) for i, (n, b) in enumerate(QUANT_TIERS)])
    df = models.select("*", F.inline(rows)).withColumn("weight_bytes", F.floor(F.col("params") * F.col("bpw") / 8).cast("long"))
    return df.withColumn("tier_fits", F.col("weight_bytes") <= F.col("max_weights"))


def recommend(table: DataFrame, by: list[str]) -> DataFrame:
    """The largest tier that fits, by model; null if none does."""
    return table.groupBy(*by).agg(F.max_by("tier", F.when(F.col("tier_fits"), F.col("ord"))).alias("tier"), F.max(F.when(F.col("tier_fits"), F.col("weight_bytes"))).alias("weight_bytes"))


def survey(configs: DataFrame, bpw: float = 4.5) -> DataFrame:
    """configs (repo, experts, hidden, inter) with slice_bytes and in_band; rows that lack a field are left out."""
    full = configs.where("experts IS NOT NULL AND hidden IS NOT NULL AND inter IS NOT NULL")
    return full.withColumn("slice_bytes", F.col("hidden") * F.col("inter") * F.lit(bpw) / 8).withColumn("in_band", F.col("slice_bytes") < PLATEAU)


def survey_summary(surveyed: DataFrame) -> DataFrame:
    return surveyed.agg(F.count_if("in_band").alias("n_in_band"), F.count(F.lit(1)).alias("n"),
        F.min_by("repo", F.struct("slice_bytes", "repo")).alias("smallest"), F.min("slice_bytes").alias("smallest_bytes"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs (key, a, b doubles) -> per key rmse, max_abs, rel_rmse, corr, n, non_finite; nulls where nothing is finite.

    One aggregation of sums, partial before the shuffle.
    """
    fin = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = fin(F.col("a")) & fin(F.col("b"))
    p = pairs.withColumn("ok", ok)
    s = lambda c: F.sum(F.when(F.col("ok"), c))
    a, b = F.col("a"), F.col("b")
    g = p.groupBy("key").agg(s(F.lit(1)).alias("n"), s((a - b) * (a - b)).alias("se"), F.max(F.when(F.col("ok"), F.abs(a - b))).alias("max_abs"),
        s(a).alias("sa"), s(b).alias("sb"), s(a * a).alias("saa"), s(b * b).alias("sbb"), s(a * b).alias("sab"),
        F.count_if(~F.col("ok")).alias("non_finite"))
    n = F.col("n")
    rmse = F.sqrt(F.col("se") / n)
    ref = F.sqrt(F.col("saa") / n)
    den = F.sqrt((F.col("saa") / n - F.pow(F.col("sa") / n, F.lit(2.0))) * (F.col("sbb") / n - F.pow(F.col("sb") / n, F.lit(2.0))))
    num = F.col("sab") / n - F.col("sa") / n * F.col("sb") / n
    return g.select("key", rmse.alias("rmse"), "max_abs", F.when(ref > 0, rmse / ref).alias("rel_rmse"), F.when(den > 0, num / den).alias("corr"), F.coalesce(n, F.lit(0)).alias("n"), "non_finite")


def compare(spark: SparkSession, path_a: str, path_b: str, name: str = "", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(agreement by tensor, skipped tensors with reasons) of two containers; the first is the reference."""
    a, b = (container.tensors(spark, p).where(F.col("name").contains(name)) for p in (path_a, path_b))
    both = a.alias("a").join(b.alias("b"), F.col("a.name") == F.col("b.name"), "full").select(F.coalesce("a.name", "b.name").alias("name"),
        F.col("a.idx").alias("idx"), F.col("a.dims").alias("da"), F.col("b.dims").alias("db"), F.col("a.ggml_type").alias("ta"),
        F.col("b.ggml_type").alias("tb"))
    reason = F.when(F.col("da").isNull(), "only in b").when(F.col("db").isNull(), "only in a").when(F.col("da") != F.col("db"),
        "dims differ").when(~F.col("ta").isin(*DECODABLE) | ~F.col("tb").isin(*DECODABLE), "type can't be decoded")
    both = both.withColumn("reason", reason)
    usable = both.where("reason IS NULL").orderBy("idx")
    if limit is not None:
        usable = usable.limit(limit)
    wanted = F.broadcast(usable.select(F.col("name").alias("tensor")))  # names of one file's header
    left = container.slices(spark, path_a, name).join(wanted, "tensor", "left_semi")
    right = container.slices(spark, path_b, name).join(wanted, "tensor", "left_semi")
    joined = left.join(right.select("tensor", "slice", F.col("ggml_type").alias("type_b"), F.col("data").alias("data_b")), ["tensor", "slice"])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for t, ka, da, kb, db in zip(pdf["tensor"], pdf["ggml_type"], pdf["data"], pdf["type_b"], pdf["data_b"], strict=True):
                ea, sa = codec.BLOCKS[ka]
                x, y = codec.decode(ka, bytes(da), len(da) // sa * ea).astype(np.float64), codec.decode(kb, bytes(db), len(da) // sa * ea).astype(np.float64)
                ok = np.isfinite(x) & np.isfinite(y)
                x, y = x[ok], y[ok]
                out.append((t, float(((x - y) ** 2).sum()), float(np.abs(x - y).max(initial=0)), float(x.sum()), float(y.sum()), float((x * x).sum()),
                    float((y * y).sum()), float((x * y).sum()), len(x), int((~ok).sum())))
            yield pd.DataFrame(out, columns=["tensor", "se", "mx", "sa", "sb", "saa", "sbb", "sab", "n", "bad"])

    part = joined.mapInPandas(sums, "tensor string, se double, mx double, sa double, sb double, saa double, sbb double, sab double, n long, bad long")
    g = part.groupBy("tensor").agg(*[F.sum(c).alias(c) for c in ("se", "sa", "sb", "saa", "sbb", "sab", "n", "bad")], F.max("mx").alias("mx"))
    n = F.col("n").cast("double")
    rmse, ref = F.sqrt(F.col("se") / n), F.sqrt(F.col("saa") / n)
    den = F.sqrt((F.col("saa") / n - F.pow(F.col("sa") / n, F.lit(2.0))) * (F.col("sbb") / n - F.pow(F.col("sb") / n, F.lit(2.0))))
    num = F.col("sab") / n - F.col("sa") / n * F.col("sb") / n
    done = g.select("tensor", rmse.alias("rmse"), F.col("mx").alias("max_abs"), F.when(ref > 0, rmse / ref).alias("rel_rmse"),
        F.when(den > 0, num / den).alias("corr"), "n", F.col("bad").alias("non_finite"))
    return done, both.where("reason IS NOT NULL").select("name", "reason")


def passes(agreements: DataFrame) -> bool:
    """Whether every tensor's correlation is above 0.99."""
    worst = agreements.agg(F.min("corr"), F.count_if(F.col("corr").isNull()), F.count(F.lit(1))).head()
    return bool(worst[2] and not worst[1] and worst[0] > 0.99)


def repack(source: str, plan: Plan, target: str, group_align: int = 0) -> dict:
    """Writes the container with each planned tensor's slices in the planned order; metadata stays as it is.

    One ordered file has one writer; slices pass through it one at a time.
    """
    plan.check()
    c = container.parse(source)
    perm = {}
    for layer in plan.layers:
        for name in layer.tensors:
            if name not in c.by_name:
                raise container.ContainerError(f"the model has no tensor {name}")
            t = c.by_name[name]
            if not t.dims or t.dims[-1] != len(layer.perm):
                raise container.ContainerError(f"{name} doesn't have {len(layer.perm)} slices")
            container.slice_bytes(t)
            perm[name] = layer.perm
    placed = container.place(c.tensors, c.alignment, group_align, set(perm))
    head = bytes(container.header(c.version, c.keys, placed, c.alignment))
    end = max([len(head), *(len(head) + t.offset + t.nbytes for t in placed)])

    def pieces() -> Iterator[bytes]:
        yield head
        at = len(head)
        f, _ = container.open_file(source)
        with f:
            for t, old in zip(placed, c.tensors, strict=True):
                yield bytes(len(head) + t.offset - at)
                order = perm.get(t.name, [0])
                size = t.nbytes // len(order)
                for e in order:
                    f.seek(c.data_start + old.offset + e * size)
                    yield f.read(size)
                at = len(head) + t.offset + size * len(order)

    put_file(target, pieces())
    return {"tensors": len(placed), "permuted": len(perm), "bytes": end, "padding": end - len(head) - sum(t.nbytes for t in placed)}


def verify(spark: SparkSession, source: str, target: str, plan: Plan) -> DataFrame:
    """(tensor, slice, problem) of every slice of target that isn't the planned slice of source; no rows: all are.

    Slices meet by their place under the permutation and are compared by SHA-256, in parallel.
    """
    a, b = (container.tensors(spark, p).select("name", "dims", "ggml_type", "nbytes") for p in (source, target))
    shape = a.alias("a").join(b.alias("b"), F.col("a.name") == F.col("b.name"), "full")
    wrong = shape.where("b.name IS NULL OR a.name IS NULL OR a.dims <> b.dims OR a.ggml_type <> b.ggml_type OR a.nbytes <> b.nbytes").select(F.coalesce("a.name", "b.name").alias("tensor"),
        F.lit(-1).cast("long").alias("slice"), F.lit("shape differs").alias("problem"))
    rows = [(n, s, e) for x in plan.layers for n in x.tensors for s, e in enumerate(x.perm)]
    moved = spark.createDataFrame(rows, "tensor string, slice long, old long")
    digest = lambda p: container.slices(spark, p).select("tensor", "slice", F.sha2("data", 256).alias("h"))
    new = digest(target).join(moved, ["tensor", "slice"], "left").withColumn("old", F.coalesce("old", "slice"))
    old = digest(source).select("tensor", F.col("slice").alias("old"), F.col("h").alias("h0"))
    bad = new.join(old, ["tensor", "old"], "left").where(F.col("h0").isNull() | (F.col("h") != F.col("h0"))).select("tensor", "slice", F.lit("bytes differ").alias("problem"))
    return wrong.unionByName(bad)
