"""Queries count every row of their tables, not a fixed number of first rows."""

import collections

import pyarrow.parquet as pq
import pytest

from routelake.operators import allocate
from routelake.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_bits_are_allocated_by_the_errors_of_all_embeddings(spark, monkeypatch):
    seen = []
    real = allocate.allocate
    monkeypatch.setattr(allocate, "allocate", lambda freq, sens, *a: seen.append(sens) or real(freq, sens, *a))
    assert catalog.bit_allocation(spark, DIR).count() == catalog.LAYERS * catalog.EXPERTS
    errors = collections.defaultdict(list)
    for r in pq.read_table(f"{DIR}/embeddings.parquet").to_pylist():
        for k in range(3):
            errors[r["vec_id"] % 64 // 16, r["vec_id"] % 16, k].append(abs(r["embedding"][k]))
    got = {(r["layer"], r["expert"], r["ord"]): r["error"] for r in seen[0].collect()}
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in errors.items()})


def test_half_of_the_tokens_are_fitted(spark):
    large = "/root/testdata/sf0.1"
    n = pq.read_metadata(f"{large}/embeddings.parquet").num_rows
    assert n > 500
    scored = {r["budget"]: r["samples"] for r in catalog.predict_sticky(spark, large).collect()}
    assert set(scored.values()) == {(n - n // 2) * catalog.LAYERS}
    assert {r["tokens"] for r in catalog.replay_default(spark, large).collect()} == {n - n // 2}
