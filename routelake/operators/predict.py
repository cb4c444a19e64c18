"""Training-free lookahead predictors of expert choices and their scores. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import stats

KINDS = ("frequency", "sticky", "markov", "sticky+markov")


def fit(wide: DataFrame, fit_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(hot, trans) of the first fit_tokens tokens: hot (layer, expert, n, hot_rank), trans (layer, prev_expert, expert, n)."""
    head = wide.where(F.col("token") < fit_tokens)
    long = head.select("layer", F.explode("experts").alias("expert"))
    return stats.hot_rank(stats.frequency(long)), stats.transitions(head)


def hottest(hot: DataFrame, n: int) -> DataFrame:
    return hot.where(F.col("hot_rank") <= n)


def skew(wide: DataFrame, fit_tokens: int, tops: list[int]) -> DataFrame:
    """Mass in the hottest experts over the fitted prefix."""
    return stats.mass_in_top(stats.frequency(wide.where(F.col("token") < fit_tokens).select("layer", F.explode("experts").alias("expert"))), tops)


def _model(hot: DataFrame, trans: DataFrame) -> DataFrame:
    """(layer, hot: ids by rank, follows: expert before -> [(expert, n)]): a row per layer, of at most experts squared entries."""
    ranked = hot.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("hot_rank", "expert"))), lambda x: x["expert"]).alias("hot"))
    by_prev = trans.groupBy("layer", "prev_expert").agg(F.collect_list(F.struct("expert", "n")).alias("to"))
    maps = by_prev.groupBy("layer").agg(F.map_from_entries(F.collect_list(F.struct("prev_expert", "to"))).alias("follows"))
    return ranked.join(maps, "layer", "left")


def context(wide: DataFrame, first: int) -> DataFrame:
    """(token, layer, experts, prev_token, prev_layer) from token `first` on; contexts may reach before it."""
    before = wide.select("layer", (F.col("token") + 1).alias("token"), F.col("experts").alias("prev_token"))
    above = wide.select("token", (F.col("layer") + 1).alias("layer"), F.col("experts").alias("prev_layer"))
    rows = wide.where(F.col("token") >= first)
    return rows.join(before, ["layer", "token"], "left").join(above, ["token", "layer"], "left")


def predictions(wide: DataFrame, fit_tokens: int, kind: str, budget: int, first: int | None = None) -> DataFrame:
    """(token, layer, experts, predicted): the predicted ids in order, distinct, at most `budget`, for tokens from `first` on.

    Sticky ids come first in the order of the previous token, then ids by summed transition counts (above 0, ties to the
    smaller id), then the hottest; which of these three a kind uses is in its name, and all are padded by the hottest.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    hot, trans = fit(wide, fit_tokens)
    rows = context(wide, fit_tokens if first is None else first).join(F.broadcast(_model(hot, trans)), "layer", "left")
    none = F.array().cast("array<int>")
    sticky = F.coalesce("prev_token", none) if "sticky" in kind else none
    if "markov" in kind:
        empty = F.array().cast("array<struct<expert:int,n:bigint>>")
        all_ = F.flatten(F.transform(F.coalesce("prev_layer", none), lambda p: F.coalesce(F.element_at("follows", p), empty)))
        rows = rows.withColumn("_all", F.coalesce(all_, empty)).withColumn("_ids", F.array_distinct(F.transform("_all", lambda x: x["expert"])))
        scored = F.transform("_ids", lambda e: F.struct((-F.aggregate(F.filter("_all", lambda x: x["expert"] == e), F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("s"), e.alias("e")))
        markov = F.transform(F.array_sort(scored), lambda x: x["e"])
    else:
        markov = none
    pool = F.array_distinct(F.concat(sticky, markov, F.coalesce("hot", none)))
    return rows.select("token", "layer", "experts", F.slice(pool, 1, budget).alias("predicted"))


def score(predicted: DataFrame) -> DataFrame:
    """One row: recall, precision (means over tokens and layers), samples, amplification (1 / precision); no rows: nulls."""
    hit = F.size(F.array_intersect("experts", "predicted"))
    rows = predicted.select((hit / F.size("experts")).alias("r"), F.when(F.size("predicted") > 0, hit / F.size("predicted")).otherwise(F.lit(0.0)).alias("p"))
    one = rows.agg(F.avg("r").alias("recall"), F.avg("p").alias("precision"), F.count(F.lit(1)).alias("samples"))
    return one.withColumn("amplification", F.when(F.col("precision") > 0, 1 / F.col("precision")).when(F.col("precision") == 0, F.lit(float("inf"))))


def evaluate(wide: DataFrame, fit_tokens: int, kinds: tuple[str, ...], budgets: list[int]) -> DataFrame:
    """(kind, budget, recall, precision, samples, amplification) of every kind and budget."""
    out = None
    for kind in kinds:
        top = predictions(wide, fit_tokens, kind, max(budgets))
        for b in budgets:
            one = score(top.withColumn("predicted", F.slice("predicted", 1, b))).select(F.lit(kind).alias("kind"), F.lit(b).alias("budget"), "recall", "precision", "samples", "amplification")
            out = one if out is None else out.unionByName(one)
    return out


def pad(first: DataFrame, hot: DataFrame, budget: int) -> DataFrame:
    """Long form of the ordered union: first (token, layer, expert, pos) padded by hot ids, distinct, `budget` a row."""
    keys = first.select("token", "layer").distinct()
    more = keys.join(hot, "layer").select("token", "layer", "expert", F.lit(1).alias("prio"), F.col("hot_rank").alias("pos"))
    both = first.select("token", "layer", "expert", F.lit(0).alias("prio"), "pos").unionByName(more)
    least = both.groupBy("token", "layer", "expert").agg(F.min(F.struct("prio", "pos")).alias("o"))
    order = Window.partitionBy("token", "layer").orderBy("o.prio", "o.pos", "expert")
    return least.withColumn("r", F.row_number().over(order)).where(F.col("r") <= budget).select("token", "layer", "expert", "r")
