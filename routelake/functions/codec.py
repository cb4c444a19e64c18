"""Quantised block formats: packing, native codecs, decoding of container types, fused products. NumPy over whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import GGML_TYPES, GROUP, NATIVE_TYPES, group_bytes, half

BITS = {name: bits for name, _, bits, _ in NATIVE_TYPES}
BLOCKS = {i: (elems, size) for i, _, elems, size in GGML_TYPES}


class CodecError(ValueError):
    """Data that a codec can't take."""


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Unsigned values at `bits` bits each, least significant bit first."""
    v = np.asarray(values, np.uint8)
    planes = (v[:, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes << np.arange(bits, dtype=np.uint8)).sum(1).astype(np.uint8)


def _away(x: np.ndarray) -> np.ndarray:
    """Halves rounded away from zero."""
    return np.trunc(x + np.copysign(np.float32(0.5), x))


def quantize(name: str, x: np.ndarray) -> bytes:
    """Native block format of a multiple of 64 weights (float32)."""
    x = np.asarray(x, np.float32)
    if len(x) % GROUP:
        raise CodecError(f"{len(x)} weights are not a multiple of {GROUP}")
    bits, g = BITS[name], x.reshape(-1, GROUP)
    out = []
    with np.errstate(all="ignore"):
        if name == "Q8":
            top = np.where(np.isfinite(g), np.abs(g), 0).max(1, initial=0).astype(np.float32)
            inverse = np.where(top > 0, np.float32(127) / top, 0).astype(np.float32)
            scale = (top / np.float32(127)).astype(np.float16)
            q = np.nan_to_num(np.clip(_away(g * inverse[:, None]), -127, 127), nan=0.0).astype(np.int8)
            for d, row in zip(scale, q, strict=True):
                out.append(d.tobytes() + row.tobytes())
            return b"".join(out)
        levels = (1 << bits) - 1
        lo, hi = np.where(np.isnan(g), np.inf, g).min(1), np.where(np.isnan(g), -np.inf, g).max(1)
        bad = ~np.isfinite(lo) | ~np.isfinite(hi)
        lo, hi = np.where(bad, 0, lo).astype(np.float32), np.where(bad, 0, hi).astype(np.float32)
        d16, lo16 = ((hi - lo) / np.float32(levels)).astype(np.float16), lo.astype(np.float16)
        d, base = d16.astype(np.float32), lo16.astype(np.float32)
        inverse = np.where(d > 0, np.float32(1) / d, 0).astype(np.float32)
        q = np.nan_to_num(np.clip(_away((g - base[:, None]) * inverse[:, None]), 0, levels), nan=0.0).astype(np.uint8)
    for a, b, row in zip(d16, lo16, q, strict=True):
        out.append(a.tobytes() + b.tobytes() + pack_bits(row, bits))
    return b"".join(out)


def dequantize(name: str, data: bytes, n: int) -> np.ndarray:
    """float32 weights of native data."""
    size = group_bytes(name)
    if n % GROUP or len(data) != n // GROUP * size:
        raise CodecError(f"{len(data)} bytes don't hold {n} weights of {name}")
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    d = raw[:, :2].copy().view(np.float16).astype(np.float32)
    if name == "Q8":
        return (d * raw[:, 2:].copy().view(np.int8).astype(np.float32)).ravel()
    lo = raw[:, 2:4].copy().view(np.float16).astype(np.float32)
    q = np.stack([unpack_bits(r.tobytes(), BITS[name], GROUP) for r in raw[:, 4:]]) if len(raw) else np.zeros((0, GROUP), np.uint8)
    return (lo + d * q.astype(np.float32)).ravel()


def roundtrip_rmse(name: str, x: np.ndarray) -> float | None:
    """Root mean square error over pairs that are finite before and after; None if there are none."""
    x = np.asarray(x, np.float32)
    y = dequantize(name, quantize(name, x), len(x))
    ok = np.isfinite(x) & np.isfinite(y)
    return float(np.sqrt(((x[ok].astype(np.float64) - y[ok]) ** 2).mean())) if ok.any() else None


def _nibbles(raw: np.ndarray) -> np.ndarray:
    """Low halves, then high halves, of each row."""
    return np.concatenate([raw & 15, raw >> 4], 1)


def _half_at(raw: np.ndarray, at: int) -> np.ndarray:
    return raw[:, at : at + 2].copy().view(np.float16).astype(np.float32)


def _q4_k(raw: np.ndarray) -> np.ndarray:
    """256 weights: 8 sub-blocks of 32 with 6-bit scales and minima in 12 bytes; nibbles pair sub-blocks."""
    d, dmin, s = _half_at(raw, 0), _half_at(raw, 2), raw[:, 4:16]
    a, b, c = s[:, :4], s[:, 4:8], s[:, 8:]
    # The first four pairs stand in the low six bits; the others take four bits of the last bytes and the top two of the first.
    scale = np.concatenate([a & 63, (c & 15) | (a >> 6) << 4], 1).astype(np.float32)
    least = np.concatenate([b & 63, (c >> 4) | (b >> 6) << 4], 1).astype(np.float32)
    q = raw[:, 16:].reshape(-1, 4, 32)
    q = np.stack([q & 15, q >> 4], 2).reshape(-1, 8, 32).astype(np.float32)
    return ((d * scale)[:, :, None] * q - (dmin * least)[:, :, None]).reshape(-1)


def _q6_k(raw: np.ndarray) -> np.ndarray:
    """256 weights: two halves of 128, each of four quarters of 32 that take two high bits from shared bytes; biased by 32."""
    low, high, scale, d = raw[:, :128].reshape(-1, 2, 2, 32), raw[:, 128:192].reshape(-1, 2, 1, 32), raw[:, 192:208].copy().view(np.int8), _half_at(raw, 208)
    nibble = np.concatenate([low & 15, low >> 4], 2)
    top = (high >> np.array([0, 2, 4, 6], np.uint8)[:, None]) & 3
    q = (nibble | top << 4).astype(np.float32) - 32
    return ((d * scale.astype(np.float32)).reshape(-1, 16, 1) * q.reshape(-1, 16, 16)).reshape(-1)


def decode(ggml_type: int, data: bytes, n: int) -> np.ndarray:
    """float32 weights of a container's tensor data; types other than the decodable ones are an error, never a guess."""
    if ggml_type not in BLOCKS:
        raise CodecError(f"type {ggml_type} is unknown")
    elems, size = BLOCKS[ggml_type]
    if n % elems or len(data) != n // elems * size:
        raise CodecError(f"{len(data)} bytes don't hold {n} weights of type {ggml_type}")
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    match ggml_type:
        case 0:
            return np.frombuffer(data, "<f4").copy()
        case 1:
            return np.frombuffer(data, "<f2").astype(np.float32)
        case 30:
            return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
        case 2:
            return (_half_at(raw, 0) * (_nibbles(raw[:, 2:]).astype(np.float32) - 8)).ravel()
        case 3:
            return (_half_at(raw, 0) * _nibbles(raw[:, 4:]).astype(np.float32) + _half_at(raw, 2)).ravel()
        case 8:
            return (_half_at(raw, 0) * raw[:, 2:].copy().view(np.int8).astype(np.float32)).ravel()
        case 12:
            return _q4_k(raw)
        case 14:
            return _q6_k(raw)
    raise CodecError(f"type {ggml_type} can't be decoded")


def fused_dot(name: str, data: bytes, a: np.ndarray) -> float:
    """The product of native weights with a vector, without their decoded form: per group d * <q, a> + lo * sum(a)."""
    a = np.asarray(a, np.float32).reshape(-1, GROUP)
    raw = np.frombuffer(data, np.uint8).reshape(-1, group_bytes(name))
    d = raw[:, :2].copy().view(np.float16).astype(np.float64)[:, 0]
    if name == "Q8":
        return float((d * (raw[:, 2:].copy().view(np.int8) * a.astype(np.float64)).sum(1)).sum())
    lo = raw[:, 2:4].copy().view(np.float16).astype(np.float64)[:, 0]
    q = np.stack([unpack_bits(r.tobytes(), BITS[name], GROUP) for r in raw[:, 4:]])
    return float((d * (q * a.astype(np.float64)).sum(1) + lo * a.sum(1, dtype=np.float64)).sum())


def register(spark) -> None:
    """SQL functions quantize_<name>(array<float>) -> binary and dequantize_<name>(binary, n) -> array<float>, Arrow-batched."""
    for name in BITS:
        pack, unpack = _udfs(name)
        spark.udf.register(f"quantize_{name.lower()}", F.pandas_udf(pack, "binary"))
        spark.udf.register(f"dequantize_{name.lower()}", F.pandas_udf(unpack, "array<float>"))


def _udfs(name: str):
    def pack(x):
        return x.map(lambda v: quantize(name, np.asarray(v, np.float32)), na_action="ignore")

    def unpack(x, n):
        return pd.Series([None if d is None else dequantize(name, d, int(k)) for d, k in zip(x, n, strict=True)])

    pack.__annotations__ = {"x": pd.Series, "return": pd.Series}
    unpack.__annotations__ = {"x": pd.Series, "n": pd.Series, "return": pd.Series}
    return pack, unpack


def roundtrip(values: Column, name: str) -> Column:
    """An array of 64 finite doubles after native quantisation, by SQL functions alone; nulls and other lengths give null."""
    away = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)
    # A one-element transform binds an array's scale once; inside the inner one it would be computed anew for every value.
    bound = lambda scale, f: F.get(F.transform(F.array(scale), lambda p: F.transform(values, lambda x: f(p, x))), F.lit(0))
    if name == "Q8":
        top = F.get(F.transform(F.array(F.array_max(F.transform(values, F.abs))), lambda t: F.struct(t.alias("top"), half(t / 127).alias("d"))), F.lit(0))
        one = lambda p, x: F.when(p["top"] > 0, F.greatest(F.lit(-127.0), F.least(F.lit(127.0), away(x * (F.lit(127.0) / p["top"])))) * p["d"]).otherwise(0.0)
        return F.when(F.size(values) == GROUP, bound(top, one))
    levels = float((1 << BITS[name]) - 1)
    ends = F.array(F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi")))
    scale = F.get(F.transform(ends, lambda e: F.struct(half(e["lo"]).alias("lo"), half((e["hi"] - e["lo"]) / levels).alias("d"))), F.lit(0))
    one = lambda p, x: p["lo"] + p["d"] * F.when(p["d"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(levels), away((x - p["lo"]) / p["d"])))).otherwise(0.0)
    return F.when(F.size(values) == GROUP, bound(scale, one))


def rmse_table(vectors: DataFrame, names: tuple[str, ...] = tuple(BITS)) -> DataFrame:
    """vectors (key, values array<double> of 64) -> (key, name, rmse) of each native format, by SQL functions."""
    rows = []
    for name in names:
        back = roundtrip(F.col("values"), name)
        se = F.aggregate(F.zip_with(F.col("values"), back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        rows.append(F.struct(F.lit(name).alias("name"), F.sqrt(se / GROUP).alias("rmse")))
    return vectors.select("key", F.inline(F.array(*rows)))


def rmse_by_codec(vectors: DataFrame, names: tuple[str, ...] = tuple(BITS)) -> DataFrame:
    """The same through the byte codecs, an Arrow batch at a time; for data that isn't finite everywhere."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, n, roundtrip_rmse(n, np.asarray(v, np.float32))) for k, v in zip(pdf["key"], pdf["values"], strict=True) for n in names]
            yield pd.DataFrame(rows, columns=["key", "name", "rmse"])

    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.select("key", "values").mapInPandas(run, f"key {kind}, name string, rmse double")


def decode_slices(slices: DataFrame, name: str) -> DataFrame:
    """Container slices (tensor, slice, ggml_type, data) -> (tensor, slice, and their weights as array<float> under name), an Arrow
    batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(t, d, len(d) // BLOCKS[t][1] * BLOCKS[t][0]) for t, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.float32)
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.float32)))], ["tensor", "slice", name])

    return slices.select("tensor", "slice", "ggml_type", "data").mapInArrow(run, f"tensor string, slice long, {name} array<float>")
