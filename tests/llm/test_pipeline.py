"""The pipeline's stages on small tables: columns, what each keeps, and that each works on what the one before kept."""

import math
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from routelake.llm import chaining, jaccard, mixing, quality
from routelake.llm.common import materialize, n_words, read

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read(spark, DIR, "documents"), []
    for _, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, DIR), "t")
        out.append(docs)
    return [read(spark, DIR, "documents"), *out]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality(spark, stages):
    kept = quality.judge(stages[0], read(spark, DIR, "labels")).where("kept")
    assert ids(stages[1]) == ids(kept)


def test_one_of_each_group(stages):
    groups = jaccard.jaccard_components(stages[1], 5, 8, 10)
    want = groups.where((F.col("doc_id") == F.col("component_id")) | (F.col("n_shingles") == 0))
    assert ids(stages[2]) == ids(want)
    again = jaccard.jaccard_components(stages[2], 5, 8, 10)
    assert again.where("doc_id <> component_id").count() == 0


def test_passages_are_cut_once(stages):
    found = {r["doc_id"] for r in chaining.find_passages(stages[2]).collect()}
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert all(after.get(d) == t for d, t in before.items() if d not in found)
    assert all(len(after.get(d, "")) < len(before[d]) for d in found)


def test_mix(stages):
    sizes = {r["source_size"]: r["target"] for r in mixing.mix(stages[3]).collect()}
    got = stages[4].agg(F.sum(n_words(F.col("text")))).head()[0]
    assert abs(got - sum(r["taken"] for r in mixing.mix(stages[3]).collect())) == 0 and sizes


def test_packed(stages):
    bins = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert bins.agg(F.max("n")).head()[0] <= 1024
    total = stages[5].agg(F.sum("length")).head()[0]
    assert bins.count() <= math.ceil(total / 1024 * 1.02) + 1


def test_empty(spark):
    docs = read(spark, DIR, "documents").where("false")
    for _, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, DIR), "t")
        assert docs.count() == 0


def test_passages_of_any_holder_are_cut(spark):
    rng = random.Random(9)
    made = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    p = made(100)
    parts = [made(9) + p[k : k + 24] + made(9) for k in range(0, 90, 12)]
    edited = [made(1)[0] if k % 11 == 6 else w for k, w in enumerate(p)]
    # The whole copy is neither the first holder of any seed nor the nearest one before the edited copy.
    texts = [*parts, made(20) + p + made(20), *[made(5) + x for x in parts], made(15) + edited + made(15)]
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, read(spark, DIR, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema)
    left = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.cut_repeated_passages(spark, docs, DIR).collect()}
    assert len(left[len(texts) - 1]) <= 40
    assert all(left[k] == texts[k] for k in range(len(texts) - 1))


def test_passages_behind_their_parts_in_one_document_are_cut(spark, monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK_BYTES", 4_000)
    rng = random.Random(10)
    made = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        p = made(100)
        texts.append(sum([made(9) + p[k : k + 24] + made(9) for k in range(0, 90, 12)], []) + made(20) + p + made(20))
        texts.append(made(15) + [made(1)[0] if k % 11 == 6 else w for k, w in enumerate(p)] + made(15))
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, read(spark, DIR, "documents").select("doc_id", "text", "lang", "source", "n_chars").schema)
    left = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.cut_repeated_passages(spark, docs, DIR).collect()}
    assert all(left[k] == texts[k] and len(left[k + 1]) <= 40 for k in range(0, 12, 2))
