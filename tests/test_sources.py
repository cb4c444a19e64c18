import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelake.operators import model
from routelake.schema import TraceError, validate_trace
from routelake.sources import container, plan, store, synth
from routelake.sources import trace as traces


def test_trace_round_trip(spark, tmp_path):
    c = synth.TraceConfig(n_tokens=300)
    t = synth.trace(spark, c).select("token", "layer", F.posexplode("experts").alias("rnk", "expert"))
    path = (tmp_path / "t.bin").as_uri()
    traces.write(t, path, 2, 32, 4, 50)
    assert traces.read_meta(path).prefill_tokens == 50
    back = traces.read(spark, path, 64)
    assert back.rdd.getNumPartitions() == 5
    assert back.exceptAll(t).count() == 0 and back.count() == t.count()


def test_old_and_broken_traces(spark, tmp_path):
    old = tmp_path / "old.bin"
    old.write_bytes(struct.pack("<8sIIII", traces.MAGIC, 1, 1, 8, 2) + np.arange(6, dtype="<u4").tobytes())
    assert [r["expert"] for r in traces.read(spark, str(old)).orderBy("token", "rnk").collect()] == list(range(6))
    for name, data in {"magic": b"X" * 40, "short": traces.MAGIC, "tail": old.read_bytes()[:-1], "shape": struct.pack("<8sIIII", traces.MAGIC, 1, 1, 2, 3), "prefill": struct.pack("<8sIIIIQ", traces.MAGIC, 2, 1, 8, 2, 9)}.items():
        p = tmp_path / name
        p.write_bytes(data)
        with pytest.raises(TraceError):
            traces.read_meta(str(p))


def test_text_trace(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("# a trace\n\n1 0 4 5\n0 1 7\n0 0 1 2\n1 1 3 3\n")
    rows = {(r["token"], r["layer"], r["rnk"]): r["expert"] for r in traces.from_text(spark, str(p)).collect()}
    assert rows == {(0, 0, 0): 1, (0, 0, 1): 2, (0, 1, 0): 7, (0, 1, 1): 7, (1, 0, 0): 4, (1, 0, 1): 5, (1, 1, 0): 3, (1, 1, 1): 3}
    for bad in ("0 0 1\n1 1 2\n", "0 0 x\n", "# nothing\n"):
        p.write_text(bad)
        with pytest.raises(TraceError):
            traces.from_text(spark, str(p))


def test_validation(spark):
    t = spark.createDataFrame([(0, 0, 0, 9), (0, 0, 1, 1)], "token long, layer int, rnk int, expert int")
    with pytest.raises(TraceError):
        validate_trace(t, 1, 4, 2)
    assert validate_trace(t, 1, 10, 2).count() == 2
    with pytest.raises(TraceError):
        validate_trace(t, 1, 10, 2, 5)


@pytest.fixture(scope="module")
def checkpoint(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("m") / "a.gguf")
    synth.checkpoint(p)
    return p


def test_container_tables(spark, checkpoint):
    c = container.parse(checkpoint)
    assert len(c.tensors) == 9 and c.value("general.alignment") == 32
    assert container.files(spark, checkpoint).head()["architecture"] == "synthetic"
    assert container.keys(spark, checkpoint).count() == 2
    m = model.inspect(container.tensors(spark, checkpoint)).orderBy("block").collect()
    assert [(r["block"], r["n_experts"], r["trace_layer"]) for r in m] == [(0, 32, 0), (1, 32, 1)]
    one = container.slices(spark, checkpoint).where(F.col("tensor") == "blk.0.ffn_up_exps.weight")
    assert one.count() == 32 and one.select(F.max(F.octet_length("data"))).head()[0] == 64 * 128 * 2


def test_repack_and_verify(spark, checkpoint, tmp_path):
    names = [t.name for t in container.parse(checkpoint).tensors if t.name.startswith("blk.0.")]
    p = plan.Plan("a", "t", [plan.Layer(0, names, random.Random(1).sample(range(32), 32), 1.5, 3.0, 2.0)])
    out = str(tmp_path / "b.gguf")
    got = model.repack(checkpoint, p, out, 4096)
    assert got["permuted"] == 4
    assert model.verify(spark, checkpoint, out, p).count() == 0
    raw = bytearray(open(out, "rb").read())
    raw[-5000] ^= 1
    broken = tmp_path / "c.gguf"
    broken.write_bytes(raw)
    assert model.verify(spark, checkpoint, str(broken), p).count() == 1
    same, skipped = model.compare(spark, checkpoint, checkpoint)
    assert model.passes(same) and skipped.count() == 0 and same.agg(F.max("rmse")).head()[0] == 0


def test_plan_text(tmp_path):
    p = plan.Plan("m", "t", [plan.Layer(0, ["a", "b"], [2, 0, 3, 1], 1.25, 4.0, 2.5)])
    path = (tmp_path / "p").as_uri()
    plan.write(p, path)
    assert plan.read(path) == p
    for bad in ("x", plan.HEAD + "\nwhat 1", plan.HEAD + "\nlayer 0 experts 2 speedup 1.0 requests 1.0 -> 1.0\ntensors a\nperm 0,0"):
        with pytest.raises(plan.PlanError):
            plan.parse(bad)


def test_store_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(layer, slot, kind, ("Q4", "Q2")[slot % 2], rng.normal(size=128).tolist()) for layer in range(2) for slot in range(5) for kind in store.KINDS]
    df = spark.createDataFrame(rows, "layer int, slot int, kind string, type string, weights array<float>")
    records = store.quantise(df).cache()
    path = (tmp_path / "s").as_uri()
    store.write(records, path, 4096, 2)
    back = store.read(spark, path)
    assert back.drop("offset").exceptAll(records.select("layer", "slot", "kind", "ty", "n_weights", "nbytes", "payload")).count() == 0
    assert store.weights(back).count() == 30
    assert store.spans(back).where("NOT contiguous").count() == 0
    align, start, parsed = store.parse(path)
    assert align == 4096 and start % 4096 == 0 and all(r[5] % 4096 == 0 for r in parsed if r[2] == "gate" and r[1] % 2 == 0)
    raw = (tmp_path / "s").read_bytes()
    for name, data in {"magic": b"Y" + raw[1:], "half": raw[: len(raw) // 2], "index": raw[:30]}.items():
        p = tmp_path / name
        p.write_bytes(data)
        with pytest.raises(store.StoreError):
            store.parse(str(p))
    assert store.effective_align(3 * 36 * 2, 2 << 20) == 4096 and store.effective_align(0, 64) == 64


def test_hostile_containers(tmp_path, checkpoint):
    """Any damage gives a container or a clean error, never another exception."""
    raw = open(checkpoint, "rb").read()[:2000]
    rng = random.Random(7)
    p = tmp_path / "x"
    for k in range(300):
        if k < 100:
            data = b"GGUF" + struct.pack("<I", 3) + rng.randbytes(rng.randrange(200))
        elif k < 200:
            data = raw[: rng.randrange(len(raw))]
        else:
            data = bytearray(raw)
            for _ in range(4):
                data[rng.randrange(len(data))] = rng.randrange(256)
        p.write_bytes(bytes(data))
        try:
            container.parse(str(p))
        except container.ContainerError:
            pass
