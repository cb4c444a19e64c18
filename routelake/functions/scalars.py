"""Scalar functions on columns, and the constant relations behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tensor element types of the container format as (id, name, elements per block, bytes per block).
GGML_TYPES = (
    (0, "F32", 1, 4), (1, "F16", 1, 2), (2, "Q4_0", 32, 18), (3, "Q4_1", 32, 20), (6, "Q5_0", 32, 22), (7, "Q5_1", 32, 24), (8, "Q8_0", 32, 34), (9, "Q8_1", 32, 36),
    (10, "Q2_K", 256, 84), (11, "Q3_K", 256, 110), (12, "Q4_K", 256, 144), (13, "Q5_K", 256, 176), (14, "Q6_K", 256, 210), (15, "Q8_K", 256, 292), (16, "IQ2_XXS", 256, 66),
    (17, "IQ2_XS", 256, 74), (18, "IQ3_XXS", 256, 98), (19, "IQ1_S", 256, 50), (20, "IQ4_NL", 32, 18), (21, "IQ3_S", 256, 110), (22, "IQ2_S", 256, 82), (23, "IQ4_XS", 256, 136),
    (24, "I8", 1, 1), (25, "I16", 1, 2), (26, "I32", 1, 4), (27, "I64", 1, 8), (28, "F64", 1, 8), (29, "IQ1_M", 256, 56), (30, "BF16", 1, 2), (34, "TQ1_0", 256, 54),
    (35, "TQ2_0", 256, 66), (39, "MXFP4", 32, 17),
)
#: Element types that can be decoded.
DECODABLE = (0, 1, 2, 3, 8, 12, 14, 30)
#: Quantisation tiers as (name, bits per weight), ascending.
QUANT_TIERS = (("IQ1_S", 1.70), ("IQ2_XXS", 2.06), ("Q2_K", 2.95), ("IQ3_XXS", 3.05), ("Q3_K_M", 3.55), ("Q4_K_M", 4.87), ("Q5_K_M", 5.65), ("Q6_K", 6.58), ("Q8_0", 8.55), ("F16", 16.0))
#: Native block formats as (name, tag, bits, symmetric), most precise first; a group has 64 weights.
NATIVE_TYPES = (("Q8", 0, 8, True), ("Q5", 1, 5, False), ("Q4", 2, 4, False), ("Q3", 3, 3, False), ("Q2", 4, 2, False))
GROUP = 64


def ggml_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GGML_TYPES, "id int, name string, block_elems long, block_bytes long")


def group_bytes(name: str) -> int:
    """Bytes of a group: the packed weights, and a half-precision scale, and an offset unless symmetric."""
    _, _, bits, symmetric = next(t for t in NATIVE_TYPES if t[0] == name)
    return GROUP * bits // 8 + (2 if symmetric else 4)


def native_types(spark: SparkSession) -> DataFrame:
    rows = [(i, n, tag, bits, group_bytes(n), group_bytes(n) * 8 / GROUP) for i, (n, tag, bits, _) in enumerate(NATIVE_TYPES)]
    return spark.createDataFrame(rows, "ord int, name string, tag int, bits int, group_bytes int, bits_per_weight double")


def align_up(n: Column, a: Column | int) -> Column:
    """The least multiple of a that is n or more; n itself if a is 1 or less."""
    a = F.lit(a) if isinstance(a, int) else a
    return F.when(a <= 1, n).otherwise(n + F.pmod(-n, a))


def n_elements(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(1).cast("long"), lambda a, x: a * x)


def tensor_bytes(tensors: DataFrame) -> DataFrame:
    """tensors (dims, ggml_type, ...) with n_elements, bits_per_weight and expected_bytes; null where the type is unknown or
    the elements don't fill whole blocks."""
    t = F.broadcast(ggml_types(tensors.sparkSession).select(F.col("id").alias("ggml_type"), F.col("name").alias("type_name"), "block_elems", "block_bytes"))
    df = tensors.withColumn("n_elements", n_elements(F.col("dims"))).join(t, "ggml_type", "left")
    whole = F.col("n_elements") % F.col("block_elems") == 0
    return df.withColumn("bits_per_weight", F.col("block_bytes") * 8.0 / F.col("block_elems")).withColumn("expected_bytes",
        F.when(whole, F.expr("n_elements div block_elems") * F.col("block_bytes"))).drop("block_elems", "block_bytes")


def slice_elements(dims: Column) -> Column:
    """Elements of one slice along the last axis."""
    return F.when(F.size(dims) > 0, n_elements(F.slice(dims, F.lit(1), F.size(dims) - 1)))


def bytes_at(weights: Column, bits: Column) -> Column:
    return F.ceil(weights * bits / 8).cast("long")


def human(n: Column) -> Column:
    """Bytes in binary units, two decimals."""
    size = n.cast("double")
    return (
        F.when(size >= 2.0**40, F.format_string("%.2f TiB", size / 2.0**40))
        .when(size >= 2.0**30, F.format_string("%.2f GiB", size / 2.0**30))
        .when(size >= 2.0**20, F.format_string("%.2f MiB", size / 2.0**20))
        .when(size >= 2.0**10, F.format_string("%.2f KiB", size / 2.0**10))
        .otherwise(F.format_string("%d B", n))
    )


def kind_of(name: Column) -> Column:
    """gate, up or down by the tensor's name; null for others."""
    return F.when(name.contains("ffn_gate_exps"), "gate").when(name.contains("ffn_up_exps"), "up").when(name.contains("ffn_down_exps"), "down")


def can_decode(ggml_type: Column) -> Column:
    return ggml_type.isin(*DECODABLE)


def verdict(ratio: Column) -> Column:
    return F.when(ratio >= 1.5, "DO").when(ratio >= 1.15, "MARGINAL").otherwise("SKIP")


def half(x: Column) -> Column:
    """A double rounded to IEEE half precision, nearest even: the value, as a double."""
    size = F.abs(x)
    e0 = F.floor(F.log2(size))
    exact = F.when(F.pow(F.lit(2.0), e0.cast("double")) > size, e0 - 1).when(F.pow(F.lit(2.0), e0.cast("double") + 1) <= size, e0 + 1).otherwise(e0)
    step = F.pow(F.lit(2.0), F.greatest(exact, F.lit(-14)).cast("double") - 10)
    rounded = F.rint(x / step) * step
    return F.when((size == 0) | F.isnan(x) | (size == float("inf")), x).when(F.abs(rounded) > 65504, F.signum(x) * float("inf")).otherwise(rounded)


def tier_seconds(n_bytes: Column, bytes_per_sec: Column) -> Column:
    return F.when(bytes_per_sec > 0, n_bytes / bytes_per_sec).otherwise(0.0)


def storage_penalty(resident_bps: Column, storage_bps: Column) -> Column:
    return F.when(storage_bps > 0, resident_bps / storage_bps).otherwise(float("inf"))
