import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routelake.functions import codec


@pytest.mark.parametrize("bits", [2, 3, 4, 5, 8])
def test_packed_values_come_back(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 64).astype(np.uint8)
    assert (codec.unpack_bits(codec.pack_bits(x, bits), bits, 64) == x).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e4, 1e4, width=32), min_size=64, max_size=64))
def test_more_bits_never_hurt_much(values):
    x = np.array(values, np.float32)
    errors = [codec.roundtrip_rmse(n, x) for n in ("Q2", "Q3", "Q4", "Q5")]
    spread = float(x.max() - x.min())
    assert all(b <= a + spread * 2e-3 + 1e-6 for a, b in zip(errors, errors[1:], strict=False))


def test_special_groups():
    assert codec.roundtrip_rmse("Q4", np.zeros(64, np.float32)) == 0
    assert codec.roundtrip_rmse("Q8", np.full(64, np.nan, np.float32)) is None
    x = np.linspace(-1, 1, 64, dtype=np.float32)
    x[3] = np.nan
    assert codec.roundtrip_rmse("Q4", x) < 0.1
    with pytest.raises(codec.CodecError):
        codec.quantize("Q4", np.zeros(63, np.float32))


@pytest.mark.parametrize("name", list(codec.BITS))
def test_fused_product(name):
    rng = np.random.default_rng(1)
    x, a = rng.normal(size=128).astype(np.float32), rng.normal(size=128).astype(np.float32)
    data = codec.quantize(name, x)
    assert codec.fused_dot(name, data, a) == pytest.approx(float(codec.dequantize(name, data, 128).astype(float) @ a), rel=1e-5, abs=1e-5)


def test_container_types():
    h = np.float16(0.5).tobytes()
    assert codec.decode(2, h + bytes([0x98] * 16), 32).tolist() == [0.0] * 16 + [0.5] * 16
    assert codec.decode(3, h + np.float16(1).tobytes() + bytes([0x21] * 16), 32).tolist() == [1.5] * 16 + [2.0] * 16
    assert codec.decode(8, h + bytes([2] * 16 + [254] * 16), 32).tolist() == [1.0] * 16 + [-1.0] * 16
    assert codec.decode(30, np.array([0x3F80], "<u2").tobytes(), 1).tolist() == [1.0]
    scales = bytes([1 | 64] * 4 + [2] * 4 + [0x31] * 4)  # the last pairs borrow a bit from the first bytes
    q4 = codec.decode(12, h + np.float16(0.25).tobytes() + scales + bytes([0x21] * 128), 256)
    assert q4[:32].tolist() == [0.5 * 1 * 1 - 0.25 * 2] * 32
    assert q4[32:64].tolist() == [0.5 * 1 * 2 - 0.25 * 2] * 32
    assert q4[128:160].tolist() == [0.5 * (1 | 1 << 4) * 1 - 0.25 * 3] * 32
    q6 = codec.decode(14, bytes([0x21] * 128) + bytes([0b11100100] * 64) + bytes([1] * 16) + h, 256)
    assert [q6[0], q6[32], q6[64], q6[96]] == [0.5 * (1 - 32), 0.5 * (1 + 16 - 32), 0.5 * (2 + 32 - 32), 0.5 * (2 + 48 - 32)]
    with pytest.raises(codec.CodecError):
        codec.decode(99, b"", 0)
    with pytest.raises(codec.CodecError):
        codec.decode(12, bytes(143), 256)


def test_sql_and_numpy_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).astype(np.float32).astype(float).tolist()) for i in range(20)] + [(20, [0.75] * 64), (21, [0.0] * 64)]
    df = spark.createDataFrame(rows, "key long, values array<double>")
    a = {(r["key"], r["name"]): r["rmse"] for r in codec.rmse_table(df).collect()}
    b = {(r["key"], r["name"]): r["rmse"] for r in codec.rmse_by_codec(df).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-3, abs=1e-6) for k in a)


def test_registered_functions(spark):
    codec.register(spark)
    got = spark.sql("SELECT dequantize_q8(quantize_q8(array_repeat(cast(1.5 AS FLOAT), 64)), 64) AS x").head()["x"]
    assert got == pytest.approx([1.5] * 64, rel=1e-2)
