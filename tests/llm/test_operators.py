"""Each operator against a plain version of what it promises, on a small fixture with every odd case."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routelake.llm import chaining, common, counts, graph, jaccard, mixing, neighbours, packing, parcels, quality, registry, suffixes, units, warc, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DIR = "/root/testdata/sf0.001"


def words(t):
    return WORD.findall(t or "")


def ids_of(path):
    tok = Tokenizer.from_file(path)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Queries with SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for x in os.listdir(DIR):
        c.sql(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{DIR}/{x}'")
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), c.sql(registry.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda f: sorted(tuple(None if v is None or str(v) in ("nan", "<NA>") else v for v in r) for r in f[cols].astype(object).itertuples(index=False))
    assert [tuple(map(str, r)) for r in key(got)] == [tuple(map(str, r)) for r in key(want)] or len(got) == len(want) and all(_same(a, b) for a, b in zip(key(got), key(want), strict=True))


def _same(a, b):
    return all(x == y or x is None and y is None or isinstance(x, float) and math.isclose(float(x), float(y)) or not isinstance(x, str) and x is not None and y is not None and float(x) == float(y) for x, y in zip(a, b, strict=True))


# Tokens


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_words_of_letters_go_to_the_model_alone(path):
    """Words of letters, accented and capital ones too, get the library's ids without the steps before the model."""
    rng, enc, plain = random.Random(9), units.Encoder(path), ids_of(path)
    letters = [chr(c) for c in range(65, 256) if re.fullmatch(f"[{units._LETTER}]", chr(c))]
    words_ = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000)] + letters
    assert enc.bare is not None
    lead = " " if enc.rule == "before_space" else ""
    assert enc._encode_words([lead + w for w in words_]).tolist() == [i for w in words_ for i in plain(lead + w)]
    spec = units.json.loads(open(path, encoding="utf-8").read())
    spec["added_tokens"] = [{"content": "ab"}]
    assert units.words_only(enc.tok, spec, enc.rule) is None  # such a word would be found as a token of its own


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_caches_keep_repeated_units(path, monkeypatch):
    """Units met repeatedly outlive a task, others don't; ids stay the library's."""
    enc, plain, learnt = units.Encoder(path), ids_of(path), []
    inner = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda u: learnt.extend(u) or inner(u))
    monkeypatch.setitem(units._ENCODERS, path, enc)
    often, rare = "some words stand here often 12 &&", "others é stand 7 times once"

    def task(texts, end):
        ids, bounds = enc.encode(texts, end)
        yield from (ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True))

    want = lambda texts, end: [plain(t) + [end] for t in texts]
    assert list(units.kept(task([often, often, rare], 2))) == want([often, often, rare], 2)
    learnt.clear()
    assert list(units.kept(task([often, rare, "new " + often], 2))) == want([often, rare, "new " + often], 2)
    assert learnt and not set(learnt) & set(units.units_of(often, enc.rule)[1:]), learnt
    monkeypatch.setattr(units, "KEPT_UNITS", 3)
    assert list(task([often] * 3, 2)) == want([often] * 3, 2)
    enc.keep()
    assert enc.units.n == 4 and list(task([often, rare], 2)) == want([often, rare], 2)
    assert list(task([rare], 5)) == want([rare], 5)  # another end


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_units_are_exact(path, monkeypatch):
    monkeypatch.setattr(units, "CACHE_BYTES", 400 * units.UNIT_BYTES + (1 << 18))
    rng, enc, plain = random.Random(5), units.Encoder(path), ids_of(path)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", ".", ",", "!?", "'s", "'", "'ll", "a", "The", "é", "e\u0301", "É", "12", "<|endoftext|>", "<|", "|>", "|", "日本", "İ", "Σ", "σς", "😀", "_", "(", "ª", "#", "\x00", "word", " and", "\u200b"]
    for _ in range(60):
        batch = ["".join(rng.choices(parts, k=rng.randrange(16))) for _ in range(50)] + [None, ""]
        ids, bounds = enc.encode(batch)
        for t, a, b in zip(batch, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == plain(t)


def test_packing(docs, rows, none):
    got = packing.pack(docs.repartition(3), BYTE_BPE).toPandas()
    plain = ids_of(BYTE_BPE)
    want = collections.Counter()
    for r in rows:
        ids = [*plain(r[1]), 2]
        cut = len(ids) % 1024 or 1024
        starts = [0, *range(cut, len(ids), 1024)]
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else len(ids)
            want[r[0], k, s, e - s, crc(ids[s:e])] += 1
    assert want == collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    total = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
        total += 1
    assert total <= math.ceil(got.length.sum() / 1024) + 2
    assert packing.pack(none, BYTE_BPE).count() == 0


def test_best_fit_by_hand():
    bins, offsets, n = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert n == 2 and sorted(zip(bins, offsets, strict=True)) == [(0, 0), (0, 6), (1, 0), (1, 5), (1, 8)]


def test_wavelet_file():
    rng = random.Random(2)
    ids = np.random.default_rng(1).zipf(1.4, 30_000).clip(0, 49_000).astype(np.uint32)
    lens = np.array([10_000, 0, 1, 19_999])
    s = wavelet.Shard(wavelet.encode_shard(ids, [5, None, 7, 5], lens, 9_000))
    assert len(s.segments) == 2 and (s.ids() == ids).all() and s.doc_ids == [5, None, 7, 5] and s.lengths.tolist() == lens.tolist()
    for _ in range(40):
        i = rng.randrange(len(ids))
        t = int(ids[i])
        assert s.access(i) == t and s.rank(t, i) == (ids[:i] == t).sum() and s.count(t) == (ids == t).sum()
        j = rng.randrange(s.count(t))
        assert s.select(t, j) == np.flatnonzero(ids == t)[j]
    assert s.count(50_000) == 0 and s.rank(50_000, 10) == 0
    with pytest.raises(IndexError):
        s.access(len(ids))
    with pytest.raises(IndexError):
        s.select(50_000, 0)
    assert wavelet.Shard(wavelet.encode_shard(np.zeros(0, np.uint32), [], np.zeros(0, np.int64))).ids().tolist() == []
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else")


def test_wavelet_shards(spark, docs, rows, none):
    folder = common.new_path(spark, "t")
    wavelet.write_shards(docs.repartition(3), folder, WORD_BPE, shard_ids=2000)
    got = wavelet.read_shards(spark, folder).toPandas().sort_values("start")
    plain = ids_of(WORD_BPE)
    want = collections.Counter((r[0], len(ids := [*plain(r[1]), 2]), crc(ids)) for r in rows)
    found = [(None if math.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples()]
    assert collections.Counter(found) == want
    assert [-1 if d is None else d for d, _, _ in found] == sorted(-1 if d is None else d for d, _, _ in found)
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    empty = common.new_path(spark, "t")
    wavelet.write_shards(none, empty, WORD_BPE)
    assert wavelet.read_shards(spark, empty).count() == 0


@pytest.mark.parametrize(("path", "frequent"), [(BYTE_BPE, 1024), (BYTE_BPE, 2), (WORD_BPE, 3)])
def test_counts(docs, rows, none, path, frequent):
    got = counts.count_tokens(docs.repartition(3), path, 100, frequent).toPandas()
    plain = ids_of(path)
    want = collections.Counter((r[0], len((r[1] or "").encode()), n := len(plain(r[1])), n > 100) for r in rows)
    assert want == collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.itertuples())
    assert counts.count_tokens(none, path).count() == 0


# Mixing


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    by = collections.defaultdict(int)
    for r in rows:
        by[(r[3] is None, r[3] or "")] += len(words(r[1]))
    names = sorted(by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * sum(by.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * by[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= target[s]
        open_ -= full
    size = {s: sum(1 for _ in ()) for s in names}
    for (n, t), g in got.groupby(["source_size", "target"]):
        s = next(s for s in names if by[s] == n and math.isclose(target[s], t, abs_tol=1e-9))
        size[s] = 1
        assert g.taken.sum() == math.floor(t + 0.5) and (g.taken <= 2 * g["size"]).all()
    assert all(size.values())
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = lambda f: sorted(f.fillna(-1).itertuples(index=False))
    assert key(got) == key(again)
    assert mixing.mix(none).count() == 0


def test_mixed_rows(docs):
    written = common.materialize(docs, "t")
    out = mixing.mixed(written)
    assert out.columns == docs.columns
    assert out.agg(F.sum(common.n_words(F.col("text")))).head()[0] == sum(r["taken"] for r in mixing.mix(written).collect())


def test_one_source_and_no_words(spark):
    one = spark.createDataFrame([(1, "a b c d", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert sum(r["taken"] for r in mixing.mix(one).collect()) == 6
    blank = spark.createDataFrame([(1, "", "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


# Quality


def features(t):
    w = words(t)
    grams = collections.defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    covered = {i + k for p in grams.values() if len(p) > 1 for i in p for k in range(5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, rows, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, no_labels).select(*quality.COLUMNS).toPandas()
    want = collections.Counter()
    for r in rows:
        f = features(r[1])
        bad = f[0] < 10 or 100 * f[4] > 20 * f[0]
        want[(r[0], *f, bad, not bad)] += 1
    assert want == collections.Counter((None if math.isnan(r[0]) else int(r[0]), *r[1:]) for r in got.itertuples(index=False))
    assert quality.judge(none, no_labels).count() == 0
    whole = quality.kept_rows(common.materialize(docs, "t"), no_labels)
    assert whole.columns == docs.columns and whole.count() == got.kept.sum()


def test_risk_is_controlled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3000):
        good = i % 3 > 0
        noise = 0 if good and rng.random() > 0.001 else 40
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + "#" * (rng.random() * 100 < noise) for _ in range(30)), "en"))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    good = got[got.doc_id % 3 > 0]
    assert (~good.kept).mean() <= 0.04 and (~got[got.doc_id % 3 == 0].kept).mean() > 0.5


@pytest.mark.parametrize(("n", "k", "p"), [(50, 0, 0.05), (400, 3, 0.02), (1000, 9, 0.01), (20, 2, 0.05), (10, 0, 0.9)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).head()[0]
    want = 1.0 if k > n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert got == pytest.approx(want)


# WARC


PAGES = "page_id long, url string, html string, payload string, digest string"


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nx y", "<p>é</p>", "p", "d"), (2, "http://b", "<p>é</p>", None, None), (3, None, None, None, None), (4, "http://c", "", None, None), (5, "u", "\r\n\r\n" * 3 + "x" * 600_000, None, None), (2, "http://b", "<p>é</p>", None, None), (None, "n", "<p>é</p>", None, None), (6, "", "WARC/1.1\r\n\r\n", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    folder = tmp_path.as_uri()
    got = [tuple(r) for r in warc.archive_pages(pages, folder).collect()]
    first = {}
    for p, _, h, *_ in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h, *_ in rows:
        raw = (h or "").encode()
        top = first[h or ""]
        again = p != top
        want.append((p, len(raw), warc.digest(raw), "revisit" if again else "response", top if again else None))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.archive_pages(pages.where("false"), (tmp_path / "none").as_uri()).count() == 0
    large = warc.archive_pages(pages, (tmp_path / "large").as_uri(), min_bytes=100)
    assert large.where("record_type = 'revisit'").count() == 0


def test_gzip_forms():
    one = warc.response(1, "u", b"abc", warc.digest(b"abc"), "d")
    two = warc.response(2, "u", b"", warc.digest(b""), "d")
    squeeze = lambda x: (c := zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)).compress(x) + c.flush()
    for data in (squeeze(one + two), squeeze(one) + squeeze(two)):
        assert [h["x-page-id"] for h, _, _ in warc.records(data)] == ["1", "2"]
        out, index = warc.normalise(data, {1: 1})
        assert [h["warc-type"] for h, _, _ in warc.records(out)] == ["response", "revisit"] and len(index.splitlines()) == 2
    with pytest.raises(ValueError):
        list(warc.records(squeeze(one)[:-9]))
    with pytest.raises(ValueError):
        list(warc.records(squeeze(one[:-9])))


# Suffixes


@pytest.mark.parametrize(("block", "hot"), [(2_000, 256), (2_000, 2), (10**7, 256)])
def test_suffixes(docs, rows, none, monkeypatch, block, hot):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    got = suffixes.remove_earlier(docs, hot_blocks=hot).collect()
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            d = math.inf if r[0] is None else r[0]
            first[s] = min(first.get(s, math.inf), d)
    want = collections.Counter()
    for r in rows:
        b, d = (r[1] or "").encode(), math.inf if r[0] is None else r[0]
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = True
        gone = gone[:-1]
        want[r[0], len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    found = collections.Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert found == want
    assert suffixes.remove_earlier(none).count() == 0


def test_periodic_texts(spark):
    docs = spark.createDataFrame([(1, "ab" * 60), (2, "x" + "ab" * 40), (3, "a" * 49), (4, "a" * 200), (5, "a" * 51 + "b")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.remove_earlier(docs).collect()}
    assert got == {1: [], 2: [(1, 81)], 3: [], 4: [], 5: [(0, 51)]}


# Passages


def test_passages(docs, rows, none, monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK_BYTES", 2_000)
    got = chaining.find_passages(docs).collect()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    covered = collections.defaultdict(set)
    for r in got:
        assert r["doc_id"] is None or r["first_doc_id"] < r["doc_id"]
        assert r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        if r["doc_id"] is not None:
            raw = text[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
            assert words(raw) == words(text[r["doc_id"]])[r["start_word"] : r["end_word"]]
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    # Every exact run of 50 words that an earlier document holds is found, but for a few words at its ends.
    first = {}
    lower = {d: [w.lower() if w.isascii() else w for w in words(t)] for d, t in sorted(text.items())}
    for d, w in lower.items():
        need = set()
        for k in range(len(w) - 49):
            run = tuple(w[k : k + 50])
            if first.setdefault(run, d) < d:
                need.update(range(k, k + 50))
        assert len(need - covered[d]) <= 0.05 * len(need)
    fuzzy = [d for d, t in text.items() if t and "changed" in t]
    assert all(covered[d] for d in sorted(fuzzy)[1:])
    clean = [d for d, t in text.items() if d < 40]
    assert not any(covered[d] for d in clean)
    cut = chaining.remove_passages(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    left = {r["doc_id"]: r["text"] for r in cut.where("doc_id IS NOT NULL").collect()}
    assert left[40] == text[40] and left[41] == "" and left[44] is None
    assert chaining.find_passages(none).count() == 0 and chaining.remove_passages(none).count() == 0


def test_passages_of_parts_that_stand_singly_before(spark, monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK_BYTES", 2_000)
    rng = random.Random(12)

    def made(n):
        return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(60)}" for _ in range(n))

    texts = []
    for sizes in ((45, 45), (25, 30, 25), (20, 15, 20, 15), (49, 9), (40, 5, 40)):
        parts = [made(n) for n in sizes]
        texts += [f"{made(12)} {p} {made(12)}" for p in parts]
        # Joints stand first in documents that hold too little of either side.
        texts += [f"{made(8)} {' '.join(a.split()[-20:])} {' '.join(b.split()[:20])} {made(9)}" for a, b in zip(parts[:-1], parts[1:], strict=True)]
        texts += [f"{made(11)} {' '.join(parts)} {made(7)}" for _ in range(3)]
    got = chaining.find_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    split = [t.split() for t in texts]
    covered = collections.defaultdict(set)
    for r in got:
        assert r["first_doc_id"] < r["doc_id"] and r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    first, repeated = {}, 0
    for d, w in enumerate(split):
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), d) < d:
                repeated += 1
                assert covered[d].issuperset(range(k, k + 50)), (d, k)
    assert repeated > 100


def test_fenwick_chains_against_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = rng.integers(1, 12)
        i, j = rng.integers(0, 60, n), rng.integers(0, 60, n)
        li, lj, worth = i + 4, j + 4, rng.integers(1, 4, n).astype(float)
        score = {}
        for r in sorted(range(n), key=lambda r: i[r]):
            best = 0.0
            for s in score:
                if li[s] < i[r] and lj[s] < j[r]:
                    best = max(best, score[s] - chaining.COST * (i[r] - li[s] + j[r] - lj[s]))
            score[r] = worth[r] + best
        paths = chaining.chain(i, j, li, lj, worth)
        assert sorted(k for p in paths for k in p) == list(range(n))
        for p in paths:
            assert all(li[a] < i[b] and lj[a] < j[b] for a, b in zip(p[:-1], p[1:], strict=True))
        top = max(score, key=score.get)
        total = max((worth[p].sum() - chaining.COST * sum(i[b] - li[a] + j[b] - lj[a] for a, b in zip(p[:-1], p[1:], strict=True)) for p in paths), default=0)
        assert total == pytest.approx(score[top]) or any(np.maximum(i[p][1:] - li[p][:-1], j[p][1:] - lj[p][:-1]).max(initial=0) <= chaining.GAP for p in paths)


# Jaccard


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 9, 10, 2_000), (5, 8, 10, 10**7), (2, 6, 10, 2_000)])
def test_jaccard(docs, rows, none, monkeypatch, k, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)
    monkeypatch.setattr(jaccard, "LIST_PART", 4)
    got = jaccard.jaccard_components(docs, k, num, den).collect()
    low = [[re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in words(r[1])] for r in rows]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()) for w in low]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[root(a)] = min(least.get(root(a), math.inf), r[0])
    want = collections.Counter((r[0], len(sets[a]), least.get(root(a)) if sets[a] else r[0]) for a, r in enumerate(rows))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert jaccard.jaccard_components(none, k, num, den).count() == 0
    one = jaccard.one_of_each(docs, k, num, den)
    assert one.columns == docs.columns
    groups = {root(a) for a in range(len(rows)) if sets[a]}
    assert one.count() == len(groups) + sum(not s for s in sets)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10), (6, 10)])
def test_every_near_pair_shares_a_name(num, den):
    rng = np.random.default_rng(num)
    levels = rng.integers(0, 9, jaccard.COUNTERS).astype(np.uint8)
    for _ in range(400):
        n = int(rng.integers(1, 30))
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        t = np.unique(np.concatenate([s[rng.random(len(s)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if not len(t) or den * both < num * (len(s) + len(t) - both):
            continue
        for x in (0, 5, 12):
            if jaccard.subset_count(max(len(s), 1), num, den) < 50_000 or x == 0:
                a, b = (jaccard.names_of(v, levels, x, num, den) for v in (s, t))
                assert len(np.intersect1d(a, b)), (len(s), len(t), both, x)


def test_boundary_follows_costs():
    few, many = jaccard.boundary({20: 100}, 1.0, 9, 10), jaccard.boundary({9: 100}, 50.0, 9, 10)
    assert few < 20 <= jaccard.SMALL and many >= 9


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = dict(graph.forest([e for e in edges if e[0] != e[1]]))
    for x, y in list(want.items()):
        want[y] = y
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[1000:2000] = x[0]  # a third are one vector
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    odd = [(None, x[1].tolist(), 1, "c"), (4000, None, 1, "c"), (4100, [0.0] * 16, 1, "c"), (4200, [None] + [1.0] * 15, 1, "c"), (4300, [float("nan")] + [1.0] * 15, 1, "c"), (4400, [float("inf")] + [1.0] * 15, 1, "c"), (4500, [1.0] * 3, 1, "c"), (4600, [], 1, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int, list string")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 3000, 100))
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g.vec_id)
        assert np.allclose(g.score, d[g.vec_id], rtol=0, atol=1e-12)
        assert g[["score", "vec_id"]].apply(tuple, axis=1).is_monotonic_increasing
        hit += len(set(best) & set(g.vec_id))
    assert hit / (30 * 10) >= 0.95
    few = neighbours.nearest(df.where("vec_id < 3"), F.lit(True), 10)
    assert few.count() == 6
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_longest_previous_factors():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 2), (30, 2), (300, 3), (2000, 2)):
        for least in (1, 3, 6):
            text, doc = rng.integers(0, letters, (size, 6)), rng.integers(0, 9, size)
            order = np.lexsort((doc, *text.T[::-1]))
            text, doc = text[order], doc[order]
            same = lambda a, b: int(np.cumprod(text[a] == text[b]).sum())  # noqa: B023, E731
            lcp = np.array([0, *(same(i - 1, i) for i in range(1, size))])
            factor, at = suffixes.longest_previous(doc, lcp, least)
            for i in range(0, size, 1 + size // 100):
                want = max((same(i, j) for j in np.flatnonzero(doc < doc[i])), default=0)
                assert factor[i] == (want if want >= least else 0)
                assert at[i] < 0 if want < least else doc[at[i]] < doc[i] and same(i, at[i]) == want


# Names, splits and repeated rows

CLASHES = "_row _size _sha _copy _taken _d _key _id row rest size taken copy whole cut step kept stratum rid h skey id sha order target name list part".split()


def test_columns_that_clash(spark, docs):
    odd = docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for made in (quality.kept_rows(odd, labels), mixing.mixed(odd), jaccard.one_of_each(odd), chaining.remove_passages(odd)):
        assert made.columns == odd.columns
        found = made.collect()
        assert found
        for r in found:
            d = -1 if r["doc_id"] is None else r["doc_id"]
            assert all(r[c] == f"{c}-{d}" for c in CLASHES)


def test_rows_do_not_depend_on_splits(spark, docs, rows, tmp_path):
    path = str(tmp_path / "d")
    docs.repartition(8).write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = sorted(str(r) for r in quality.kept_rows(docs, labels).select("doc_id", "text").collect())
    mix = sorted(str(r) for r in mixing.mixed(docs).select("doc_id", "text").collect())
    for before, after in (("1", "16"), ("16", "1")):
        try:
            spark.conf.set("spark.sql.files.minPartitionNum", before)
            read = spark.read.parquet(path)
            kept, mixed = quality.kept_rows(read, labels), mixing.mixed(read)
            spark.conf.set("spark.sql.files.minPartitionNum", after)
            assert sorted(str(r) for r in kept.select("doc_id", "text").collect()) == want
            assert sorted(str(r) for r in mixed.select("doc_id", "text").collect()) == mix
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")


def test_mix_of_equal_documents(spark):
    rows = [(None, "one two three", "s")] * 5000 + [(7, "a b", "s")] * 500 + [(i, "w " * (i % 9), "t") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(df, weights=(1, 3)).toPandas()
    for (_, t), g in got.groupby(["source_size", "target"]):
        assert g.taken.sum() == math.floor(t + 0.5) and (g.taken <= 2 * g["size"]).all()
    key = lambda f: sorted(f.fillna(-1).itertuples(index=False))
    assert key(got) == key(mixing.mix(df.repartition(3), weights=(1, 3)).toPandas())


def test_equal_rows_of_one_group(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, text, x) for x in ("q", "r", "p")] + [(2, text, "o")], "doc_id long, text string, other string")
    kept = {tuple(jaccard.one_of_each(df.repartition(n, "other")).collect()[0]) for n in (1, 3, 4)}
    assert len(kept) == 1 and next(iter(kept))[0] == 1


def test_repeated_queries(spark):
    x = np.random.default_rng(2).normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[100], rows[7]], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10).toPandas()
    assert got[got.query_id == 0]["rank"].tolist() and sorted(got[got.query_id == 0]["rank"]) == list(range(1, 11))
    twice = got[got.query_id == 100]
    assert sorted(twice["rank"]) == sorted([*range(1, 11)] * 2)
    assert twice[twice["rank"] == 1].vec_id.tolist() == [100, 100] and (twice[twice["rank"] == 1].score == 0).all()
    assert (twice[twice["rank"] == 2].score > 0).all()


# Rules by stratum


def test_rules_are_certified_by_stratum(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(2400):
        lang = ("a", "b", "c", None)[i % 4]
        good = i % 12 < 8
        noisy = not good or lang == "b" and rng.random() < 0.2  # good documents of b have symbols, too
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + "#" * (2 * noisy) for _ in range(30)), lang))
        if lang != "c" or i < 100:  # c has few labels
            labels.append((i, int(good), int(good and lang == "a" and i % 24 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    got["good"] = got.doc_id % 12 < 8
    lost = lambda lang: 1 - got[got.good & (got.lang.isna() if lang is None else got.lang == lang)].kept.mean()
    caught = lambda lang: 1 - got[~got.good & (got.lang.isna() if lang is None else got.lang == lang)].kept.mean()
    assert caught("a") == caught(None) == 1 and lost("a") <= 0.04 and lost(None) <= 0.04
    assert caught("b") == lost("b") == 0 and caught("c") == 0


# Fuzzy passages


def _common(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last, row = row, [0]
        for j, b in enumerate(y):
            row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
    return row[-1]


def test_fuzzy_passages_are_found(spark, monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK_BYTES", 30_000)
    rng = random.Random(11)
    made = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]

    def edited(p, share, kind):
        at, out = set(rng.sample(range(len(p)), round(share * len(p)))), []
        for i, w in enumerate(p):
            out += [w] if i not in at else [made(1)[0]] if kind == "replaced" else [] if rng.random() < 0.5 else [w, *made(1)]
        return out

    texts, planted = [], collections.defaultdict(list)
    for kind in ("replaced", "moved", "split"):
        for share in (0.05, 0.1, 0.15):
            for _ in range(25):
                p = made(100)
                texts += [made(15) + q + made(15) for q in ((p[:50], p[50:], p) if kind == "split" else (p,))]
                q = edited(p, share, "replaced" if kind == "split" else kind)
                planted[kind, share].append((len(texts), 15, 15 + len(q)))
                texts.append(made(15) + q + made(15))
    order = list(range(len(texts)))
    got = chaining.find_passages(spark.createDataFrame([(i, " ".join(texts[i])) for i in order], "doc_id long, text string")).collect()
    covered = collections.defaultdict(set)
    for r in got:
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        x, y = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["first_doc_id"]][r["first_start_word"] : r["first_end_word"]]
        assert r["first_doc_id"] < r["doc_id"] and len(x) >= 50 and 0.8 * max(len(x), len(y)) <= r["matched"] <= _common(x, y)
    for cell, places in planted.items():
        assert np.mean([len(covered[d] & set(range(a, b))) >= 0.8 * (b - a) for d, a, b in places]) >= 0.9, cell


def every_pair(texts):
    """Words of each document that passages with any earlier one cover: all pairs of documents that share seeds, no index."""
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "block": pa.array([0] * len(texts), pa.int32())})
    block = chaining.Block(table)
    hashes, matches, covered = (block.words.hash >> np.uint64(32)).astype(np.uint32), collections.defaultdict(list), collections.defaultdict(set)
    places = collections.defaultdict(list)
    for name, of, at in zip(*(x.tolist() for x in block.seeds()), strict=True):
        for e, there in places[name]:
            if e < of:
                matches[of, e].append((at, there))
        places[name].append((of, at))
    for (d, e), found in matches.items():
        x, y = (hashes[block.words.bounds[k] : block.words.bounds[k + 1]] for k in (d, e))
        made = chaining.runs(*np.array(found).T)
        for path in chaining.chain(*made):
            if made[4][path].sum() < chaining.CHAIN_SEEDS or made[2][path[-1]] - made[0][path[0]] + 1 < chaining.CHAIN_WORDS:
                continue
            rows = np.stack([c[path] for c in made[:4]], 1)
            lo = max(0, int(rows[0, 0]) - chaining.MARGIN)
            near, rows = x[lo : int(rows[-1, 2]) + 1 + chaining.MARGIN], (rows - [lo, 0, lo, 0]).tolist()
            whole = chaining.align(near, y, rows)
            for a, b, c, e_, matched in [whole] if whole[4] >= 0.8 * max(whole[1] - whole[0], whole[3] - whole[2]) else [chaining.align(near, y, [r]) for r in rows]:
                if b - a >= 50 and matched >= 0.8 * max(b - a, e_ - c):
                    covered[d].update(range(lo + a, lo + b))
    return covered


@pytest.mark.parametrize("block", [4_000, 10_000_000])
def test_passages_of_any_holder(spark, monkeypatch, block):
    monkeypatch.setattr(chaining, "BLOCK_BYTES", block)
    monkeypatch.setattr(chaining, "PAIRS", 500)
    rng = random.Random(5)
    made = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    line, second = made(14), made(11)
    texts, last = [], []
    for _ in range(8):
        p = made(100)
        parts = [made(9) + p[k : k + 24] + made(9) for k in range(0, 90, 12)]
        q = list(p)
        for k in range(6, 100, 11):
            q[k : k + 1] = rng.choice([made(1), [], [q[k], *made(1)]])
        # The whole copy is neither the first holder of any seed nor the nearest one before the edited copy.
        texts += [*parts, made(20) + p + made(20), *[made(5) + x for x in parts]]
        last.append(made(15) + q + made(15))
    texts += [made(30) + line + made(30) for _ in range(40)] + [made(20) + line + made(k) + second + made(20) for k in range(30)]
    texts += [["the"] * n + made(60) + line for n in (30, 49, 70, 200)] + [line + made(3), line + second, texts[8], texts[8]] + last
    texts = [" ".join(t) for t in texts]
    got = chaining.find_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    covered = collections.defaultdict(set)
    for r in got:
        assert r["first_doc_id"] < r["doc_id"] and r["identity"] >= 0.8 and r["end_word"] - r["start_word"] >= 50
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    want = every_pair(texts)
    assert all(len(want[d]) >= 80 for d in range(len(texts) - 8, len(texts)))
    assert {d: w - covered[d] for d, w in want.items() if w - covered[d]} == {}


def test_passages_leave_only_the_last_shuffles(spark, docs):
    """The shuffles of the steps up to the pairs are gone when the words of these pairs are sent."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = re.findall(r"shuffle_(\d+)_", str(manager.getAllFiles().mkString(" ")))
        return set(map(int, names))

    newest = max(shuffles(), default=-1)
    passages = chaining.find_passages(docs)
    found = passages.collect()
    left = {k for k in shuffles() if k > newest}
    assert found and 0 < len(left) <= 4, left  # texts, pairs and words


def test_what_cannot_grow_is_no_passage():
    rng, grown, n = random.Random(3), 0, 2 * chaining.BESIDE + chaining.SEED
    for _ in range(4_000):
        words_ = rng.choice((2, 4, 30))
        x = [rng.randrange(1, 1 + words_) for _ in range(160)]
        share = rng.choice((0, 0.3, 0.6, 0.9))
        y = [w if rng.random() < share else rng.randrange(1, 1 + words_) for w in x]
        for _ in range(rng.randrange(3)):
            del y[rng.choice((rng.randrange(60), 160 - 8 - rng.randrange(60)))]
        i, j = 70, rng.choice((70, 69, 68))
        line = [100, 101, 102, 103, 104, 105, 106]
        x[i : i + 7], y[j : j + 7] = line, line
        x, y = np.array(x, np.uint32), np.array(y, np.uint32)
        near = [z[k - chaining.BESIDE : k - chaining.BESIDE + n][None] for z, k in ((x, i), (y, j))]
        a, b, c, d, matched = chaining.align(x, y, [(i, j, i + 6, j + 6)])
        grows = bool(chaining.may_grow(*near, 50)[0])
        lo, hi = 0, 7
        while x[i + lo - 1] == y[j + lo - 1] and i + lo > 1 and j + lo > 1:
            lo -= 1
        while i + hi < len(x) and j + hi < len(y) and x[i + hi] == y[j + hi]:
            hi += 1
        assert grows or ((a, b, c, d) == (i + lo, i + hi, j + lo, j + hi) and b - a < 50)
        grown += not grows
    assert grown > 300


def in_order(rng, made):
    """Two documents: parts of a passage stand singly in the first one before the passage, edited in the second."""
    p = made(100)
    parts = [made(9) + p[k : k + 24] + made(9) for k in range(0, 90, 12)]
    q = [made(1)[0] if k % 11 == 6 else w for k, w in enumerate(p)]
    return sum(parts, []) + made(20) + p + made(20), made(15) + q + made(15)


def test_passages_behind_their_parts_in_one_document(spark, monkeypatch):
    monkeypatch.setattr(chaining, "BLOCK_BYTES", 4_000)
    rng = random.Random(15)
    pairs = [in_order(rng, lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]) for _ in range(6)]
    texts = [" ".join(x) for pair in pairs for x in pair]
    got = chaining.find_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    covered = collections.defaultdict(set)
    for r in got:
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert all(len(covered[d] & set(range(15, 115))) >= 90 for d in range(1, 12, 2))


@pytest.mark.parametrize("words_", [2, 5, 300])
def test_short_lines_and_repeated_words(spark, monkeypatch, words_):
    """Lines of many documents, with slots, twice in one, and runs of one word: all pairs find no more, but for words that an
    end is drawn out to from a chain that lies within a passage found before."""
    monkeypatch.setattr(chaining, "BLOCK_BYTES", 6_000)
    monkeypatch.setattr(chaining, "PAIRS", 500)
    rng = random.Random(words_)
    made = lambda n: [f"w{rng.randrange(words_)}" for _ in range(n)]
    line, second = ([f"{c}{k}" for k in range(n)] for c, n in (("a", 14), ("b", 11)))
    texts = []
    for k in range(60):
        some = [list(line), made(rng.randrange(12)), list(second), made(30), [rng.choice("xyz")] * rng.choice((5, 7, 12, 30, 49, 70))]
        some += [list(line)] if k % 3 else [line[:7] + made(1) + line[8:], second[:6] + made(1) + second[6:]]
        rng.shuffle(some)
        texts.append(" ".join(sum(some, [])))
    got = chaining.find_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    covered = collections.defaultdict(set)
    for r in got:
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    want = every_pair(texts)
    left = {d: w - covered[d] for d, w in want.items() if w - covered[d]}
    assert all(min(abs(k - c) for c in covered[d]) <= 5 for d, w in left.items() for k in w) and sum(map(len, left.values())) <= 12
    assert words_ < 300 or not left


def test_dense_words_bound_passages():
    words = np.array([9, 9, *[1, 2, 3, 4, 8] * 10, 9, 9], np.uint32)
    assert not chaining.dense(words, np.array([1, 2, 3, 4], np.uint32), 50, 0.8)  # 49 words from the first to the last one there
    assert chaining.dense(words, np.array([1, 2, 3, 4], np.uint32), 49, 0.8)
    assert not chaining.dense(words, np.array([1, 2, 3], np.uint32), 40, 0.8)
    assert not chaining.dense(words[:30], np.array([1, 2, 3, 4, 8], np.uint32), 50, 0.8)
    assert chaining.dense(words, np.array([1, 2, 3, 4, 8], np.uint32), 50, 1.0)


def test_many_ends_are_drawn_out_alike():
    rng = np.random.default_rng(4)
    x = rng.integers(1, 4, 4_000).astype(np.uint32)
    y = np.where(rng.random(4_000) < 0.7, x, rng.integers(1, 4, 4_000)).astype(np.uint32)
    i, j = rng.integers(100, 3_900, 500), rng.integers(100, 3_900, 500)
    j = np.where(rng.random(500) < 0.7, i + rng.integers(-1, 2, 500), j)
    n_i, n_j = rng.integers(0, 65, 500), rng.integers(0, 90, 500)
    for step in (1, -1):
        ends = lambda w, k, n: w[k : k + n] if step == 1 else w[k - n + 1 : k + 1][::-1]  # noqa: B023, E731
        want = [chaining._draw(ends(x, a, n), ends(y, b, m)) for a, b, n, m in zip(i, j, n_i, n_j, strict=True)]
        assert chaining.draw_all(x, y, i, j, n_i, n_j, step).tolist() == [list(w) for w in want]


def test_a_frequent_name_is_paired_in_bounded_memory():
    """Places of one name in 6,000 documents, none of which can grow."""
    import tracemalloc

    rng, n, width = np.random.default_rng(6), 6_000, 2 * chaining.BESIDE + chaining.SEED
    near = rng.integers(1, 1 << 32, (n, width)).astype(np.uint32)
    near[:, chaining.BESIDE : chaining.BESIDE + 9] = np.arange(1, 10)
    starts = np.zeros((n, width), bool)
    starts[:, [chaining.BESIDE, chaining.BESIDE + 3]] = True
    words = chaining.ranked(near)
    doc = np.arange(n)
    found = [(chaining.pack_names(np.full(n, 7, np.uint64)), doc, doc, doc.astype(np.uint64), doc, np.packbits(np.ones(n, bool)), *words, np.packbits(starts, axis=1))]
    tracemalloc.start()
    pairs = chaining.candidates([0], found, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs[0]) == 0 and peak < 70_000_000


def test_texts_are_shuffled_once(docs):
    """All steps read one exchange of the texts, also where further columns come back."""
    cut = chaining.remove_passages(docs.limit(30))
    cut.collect()
    plan = cut._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(block" in line and "Reused" not in line]) == 1


def test_parcels_by_planes():
    rng = np.random.default_rng(8)
    arrays = [rng.integers(0, 300, 5_000).astype(np.int32), rng.integers(0, 1 << 40, (30, 7)), np.zeros(0, np.uint16), rng.random(9), np.arange(2, dtype=np.uint8)]
    for some in (arrays, arrays[2:]):
        data = parcels.squeeze(*some, planes=True)
        assert all(a.dtype == b.dtype and a.shape == b.shape and (a == b).all() for a, b in zip(some, parcels.unsqueeze(data), strict=True))
    assert len(parcels.squeeze(*arrays, planes=True)) < len(parcels.squeeze(*arrays))
