"""Table shapes of the engine and the checks that a routing trace must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACE = "token long, layer int, rnk int, expert int"
TRACE_WIDE = "token long, layer int, experts array<int>"
TRACE_META = "n_layers int, n_experts int, top_k int, n_tokens long, prefill_tokens long"
SURFACE = "cell_idx int, blob_bytes long, queue_depth int, bytes_per_sec double"
SENS = "layer int, expert int, bits double, error double"
LAYOUT = "layer int, slot int, expert int"
STORE_RECORD = "layer int, slot int, kind string, ty int, n_weights long, offset long, nbytes long"
TENSOR = "idx int, name string, dims array<bigint>, ggml_type int, offset long, nbytes long"


class TraceError(ValueError):
    """A trace breaks one of its invariants."""


def trace_faults(trace: DataFrame, n_layers: int, n_experts: int, top_k: int, prefill_tokens: int = 0) -> DataFrame:
    """One row of counts, all 0 for a valid trace: rows out of range, incomplete (token, layer) pairs, missing pairs, bad shape.

    One aggregation by (token, layer), then one over it; nothing but the counts leaves the executors.
    """
    row = (
        ((F.col("expert") < 0) | (F.col("expert") >= n_experts)).cast("int").alias("bad_expert"),
        ((F.col("layer") < 0) | (F.col("layer") >= n_layers)).cast("int").alias("bad_layer"),
    )
    pairs = trace.select("token", "layer", "rnk", *row).groupBy("token", "layer").agg(F.countDistinct("rnk").alias("k"),
        F.count(F.lit(1)).alias("rows"), F.sum("bad_expert").alias("bad_expert"), F.sum("bad_layer").alias("bad_layer"))
    total = pairs.agg(
        F.coalesce(F.sum("bad_expert"), F.lit(0)).alias("bad_experts"),
        F.coalesce(F.sum("bad_layer"), F.lit(0)).alias("bad_layers"),
        F.coalesce(F.sum(((F.col("k") != top_k) | (F.col("rows") != top_k)).cast("long")), F.lit(0)).alias("bad_rows"),
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.max("token") + 1, F.lit(0)).alias("tokens"),
    )
    shape = n_layers <= 0 or n_experts <= 0 or top_k <= 0 or top_k > n_experts
    return total.select(
        "bad_experts",
        "bad_layers",
        "bad_rows",
        (F.col("tokens") * n_layers - F.col("pairs")).alias("missing_pairs"),
        F.when(F.col("tokens") < prefill_tokens, 1).otherwise(0).cast("long").alias("bad_prefill"),
        F.lit(int(shape)).cast("long").alias("bad_shape"),
    )


def validate_trace(trace: DataFrame, n_layers: int, n_experts: int, top_k: int, prefill_tokens: int = 0) -> DataFrame:
    """The trace itself, or TraceError with the counts of what is wrong."""
    faults = {k: v for k, v in trace_faults(trace, n_layers, n_experts, top_k, prefill_tokens).head().asDict().items() if v}
    if faults:
        raise TraceError(f"the trace is not valid: {faults}")
    return trace
