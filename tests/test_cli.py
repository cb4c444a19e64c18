"""Every command on a small checkpoint and trace, from making them to the report."""

import pytest

from routelake import cli
from routelake.operators import surface as surfaces
from routelake.plans import derive


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    cli.main(["synth", "--out", f"{d}/m.gguf", "--trace", f"{d}/t.bin", "--tokens", "300", "--prefill", "40", "--clusters", "8"], spark)
    surfaces.to_json(derive.surface(spark), f"{d}/s")
    return d


def run(spark, capsys, *args):
    cli.main([str(a) for a in args], spark)
    return capsys.readouterr().out


def test_commands(spark, files, capsys):
    d = files
    m, t, p = ("--model", f"{d}/m.gguf"), ("--trace", f"{d}/t.bin"), ("--probe", f"{d}/s")
    assert "spread" in run(spark, capsys, "probe", *p)
    assert "ffn_gate_exps" in run(spark, capsys, "inspect", *m)
    assert '"fits":true' in run(spark, capsys, "fit", *m, "--ram", 16, "--json")
    assert "F16" in run(spark, capsys, "fit", *m, "--ram", 16, "--recommend-quant")
    assert "sticky+markov" in run(spark, capsys, "predict", *t)
    assert "requests a token" in run(spark, capsys, "analyse", *m, *t, *p)
    run(spark, capsys, "plan", *m, *t, *p, "--min-speedup", 0, "--out", f"{d}/p")
    assert "permuted" in run(spark, capsys, "pack", *m, "--plan", f"{d}/p", "--out", f"{d}/r.gguf")
    with pytest.raises(SystemExit) as e:
        run(spark, capsys, "verify", *m, "--repacked", f"{d}/r.gguf", "--plan", f"{d}/p")
    assert e.value.code == 0
    assert "PASS" in run(spark, capsys, "compare", f"{d}/m.gguf", f"{d}/m.gguf", "--tensor", "blk.0")
    run(spark, capsys, "build-store", *m, *t, *p, "--out", f"{d}/store", "--ram-mib", 1)
    assert "hit_rate" in run(spark, capsys, "bench", "--store", f"{d}/store", *t, *p, "--cache-mib", 1, "--budget", 4)
    assert "segmented cache" in run(spark, capsys, "advise", *m, *t, *p, "--cache-mib", 1)
    assert "cache and prefetch" in run(spark, capsys, "advise", *m, *p)


def test_engine_report(spark, tmp_path, capsys):
    from routelake.plans.catalog import ENGINES

    spark.createDataFrame(ENGINES, "engine string, qd int, dontcache boolean, gbps double").write.json(str(tmp_path / "k"))
    assert "recommend" in run(spark, capsys, "kio", "--rows", tmp_path / "k")
