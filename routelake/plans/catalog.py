"""The engine's queries over general tables, each with the SQL that says the same to another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, scalars
from ..operators import advise, allocate, cache, layout, model, predict, replay, stats
from ..operators import surface as surfaces
from ..schema import trace_faults
from . import derive
from .derive import EXPERTS, LAYERS, TOP_K, table

QUERIES: dict = {}
ORACLES: dict = {}

TRACE_SQL = """
logits AS (SELECT vec_id AS token, i // 16 AS layer, i % 16 AS expert, embedding[i + 1] AS v FROM embeddings, range(0, 64) AS r(i)),
ranked AS (SELECT token, layer, expert, row_number() OVER (PARTITION BY token, layer ORDER BY v DESC, expert) AS r FROM logits),
trace AS (SELECT token, layer::INT AS layer, (r - 1)::INT AS rnk, expert::INT AS expert FROM ranked WHERE r <= 4)"""
RAGGED_SQL = "trace AS (SELECT DISTINCT l_orderkey AS token, 0 AS layer, l_suppkey AS expert FROM lineitem)"
N_SQL = "n AS (SELECT count(*) AS n FROM embeddings)"
FIT_SQL = "(SELECT greatest(1, least(count(*) // 2, count(*) - 1)) FROM embeddings)"
SURFACE_SQL = "surface(cell_idx, blob_bytes, queue_depth, bytes_per_sec) AS (VALUES " + ", ".join(f"({i}, {b}, {q}, {v!r}::DOUBLE)" for i, b, q, v in derive.surface_cells()) + ")"
LOG_SQL = "log AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, user_id AS key FROM events)"
R = 9  # digits that float results are rounded to


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in cols})


def n_tokens(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def fit_tokens(spark: SparkSession, sf_dir: str) -> int:
    """Tokens that predictors are fitted on: half of them by default."""
    n = n_tokens(spark, sf_dir)
    return max(1, min(n // 2, n - 1))


# Traces


@query(f"WITH {TRACE_SQL} SELECT * FROM trace")
def routing_topk(spark, sf_dir):
    return derive.trace(spark, sf_dir)


@query(f"WITH {TRACE_SQL} SELECT count(*) FILTER (expert < 0 OR expert >= 16) AS bad_experts, count(*) FILTER (layer >= 4) AS bad_layers, 0::BIGINT "
    f"AS bad_rows, (SELECT (max(token) + 1) * 4 - count(DISTINCT (token, layer)) FROM trace)::BIGINT AS missing_pairs, 0::BIGINT AS bad_prefill, 0::BIGINT AS bad_shape FROM trace")
def trace_validation(spark, sf_dir):
    return trace_faults(derive.trace(spark, sf_dir), LAYERS, EXPERTS, TOP_K, 100)


@query(f"WITH {TRACE_SQL} SELECT CASE WHEN token < 100 THEN 'prefill' ELSE 'decode' END AS phase, layer, count(*) AS selections, count(DISTINCT token) AS tokens FROM trace GROUP BY ALL")
def phase_split(spark, sf_dir):
    t = derive.trace_wide(spark, sf_dir).select(F.when(F.col("token") < 100, "prefill").otherwise("decode").alias("phase"), "layer", F.size("experts").alias("k"))
    return t.groupBy("phase", "layer").agg(F.sum("k").alias("selections"), F.count(F.lit(1)).alias("tokens"))


@query(f"WITH {TRACE_SQL} SELECT layer, expert::INT AS expert, count(trace.token) AS n FROM (SELECT l::INT AS layer, e::INT AS expert FROM range(0, "
    f"4) a(l), range(0, 16) b(e)) LEFT JOIN trace USING (layer, expert) GROUP BY ALL")
def expert_frequency(spark, sf_dir):
    return stats.frequency(derive.trace_wide(spark, sf_dir).select("layer", F.explode("experts").alias("expert")), EXPERTS)


@query(f"WITH {RAGGED_SQL} SELECT layer, expert, count(*) AS n FROM trace GROUP BY ALL")
def expert_frequency_orders(spark, sf_dir):
    return stats.frequency(derive.ragged_trace(spark, sf_dir))


@query(f"WITH {TRACE_SQL} SELECT a.layer, a.expert AS ea, b.expert AS eb, count(*) AS n FROM trace a JOIN trace b ON a.token = b.token AND a.layer = b.layer AND a.expert < b.expert GROUP BY ALL")
def coactivation_pairs(spark, sf_dir):
    return stats.coactivation(derive.trace_wide(spark, sf_dir))


@query(f"WITH {RAGGED_SQL} SELECT a.layer, a.expert AS ea, b.expert AS eb, count(*) AS n FROM trace a JOIN trace b ON a.token = b.token AND a.expert < b.expert GROUP BY ALL")
def coactivation_pairs_orders(spark, sf_dir):
    return stats.coactivation(stats.to_wide(derive.ragged_trace(spark, sf_dir)))


_RANKED = f"WITH {TRACE_SQL}, f AS (SELECT layer, expert, count(*) AS n FROM trace GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, expert) AS r FROM f)"


@query(f"{_RANKED} SELECT layer, top, round(sum(CASE WHEN r <= top THEN n ELSE 0 END) / sum(n)::DOUBLE, {R}) AS mass FROM h, (VALUES (1), (2), (4), (8)) t(top) GROUP BY ALL")
def mass_in_top(spark, sf_dir):
    f = stats.frequency(derive.trace_wide(spark, sf_dir).select("layer", F.explode("experts").alias("expert")))
    return rounded(stats.mass_in_top(f, [1, 2, 4, 8]), "mass")


@query(f"WITH {RAGGED_SQL}, f AS (SELECT layer, expert, count(*) AS n FROM trace GROUP BY ALL), h AS (SELECT *, row_number() OVER (ORDER BY n DESC, "
    f"expert) AS r FROM f) SELECT layer, top, round(sum(CASE WHEN r <= top THEN n ELSE 0 END) / sum(n)::DOUBLE, {R}) AS mass FROM h, (VALUES (1), (10), (50)) t(top) GROUP BY ALL")
def mass_in_top_orders(spark, sf_dir):
    return rounded(stats.mass_in_top(stats.frequency(derive.ragged_trace(spark, sf_dir)), [1, 10, 50]), "mass")


@query(f"WITH {TRACE_SQL}, f AS (SELECT layer, expert, count(*) AS n FROM trace WHERE token < {FIT_SQL} GROUP BY ALL), h AS (SELECT *, row_number() "
    f"OVER (PARTITION BY layer ORDER BY n DESC, expert) AS r FROM f) SELECT layer, top, round(sum(CASE WHEN r <= top THEN n ELSE 0 END) / "
        f"sum(n)::DOUBLE, {R}) AS mass FROM h, (VALUES (2), (4)) t(top) GROUP BY ALL")
def expert_skew_by_layer(spark, sf_dir):
    return rounded(predict.skew(derive.trace_wide(spark, sf_dir), fit_tokens(spark, sf_dir), [2, 4]), "mass")


@query(f"{_RANKED} SELECT layer, expert, n, r::INT AS hot_rank FROM h WHERE r <= 4")
def hottest_experts(spark, sf_dir):
    f = stats.frequency(derive.trace_wide(spark, sf_dir).select("layer", F.explode("experts").alias("expert")))
    return predict.hottest(stats.hot_rank(f), 4)


@query(f"WITH {TRACE_SQL}, p AS (SELECT a.layer, a.expert, b.expert AS partner, count(*) AS n FROM trace a JOIN trace b ON a.token = b.token AND "
    f"a.layer = b.layer AND a.expert <> b.expert GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer, expert ORDER BY n DESC, partner)::INT AS rank FROM p) WHERE rank <= 3")
def partner_topk(spark, sf_dir):
    return stats.top_partners(stats.coactivation(derive.trace_wide(spark, sf_dir)), 3)


@query(f"WITH {TRACE_SQL} SELECT l::INT AS layer, e::INT AS expert FROM range(0, 4) a(l), range(0, 20) b(e) WHERE NOT EXISTS (SELECT 1 FROM trace t WHERE t.layer = l AND t.expert = e)")
def never_selected(spark, sf_dir):
    return stats.never_selected(derive.trace_wide(spark, sf_dir).select("layer", F.explode("experts").alias("expert")), 20)


_UNION = "SELECT layer, {w} AS w, round(sum(u) / any_value(f)::DOUBLE, 9) AS mean_union FROM (SELECT layer, token // {w} AS win, count(DISTINCT expert) AS u, any_value(n.n // {w}) AS f FROM trace, n WHERE token < n.n // {w} * {w} GROUP BY ALL) GROUP BY layer"


@query(f"WITH {TRACE_SQL}, {N_SQL} SELECT layer, 1 AS w, 4.0::DOUBLE AS mean_union FROM trace GROUP BY layer UNION ALL " + " UNION ALL ".join(_UNION.format(w=w) for w in (2, 4, 8)))
def window_union(spark, sf_dir):
    return rounded(stats.window_union(derive.trace_wide(spark, sf_dir), [1, 2, 4, 8], n_tokens(spark, sf_dir), TOP_K, EXPERTS), "mean_union")


@query(f"WITH {TRACE_SQL} SELECT b.layer, count(a.expert) AS reused, count(*) AS total, round(count(a.expert) / count(*)::DOUBLE, {R}) AS overlap "
    f"FROM trace b LEFT JOIN trace a ON a.token = b.token - 1 AND a.layer = b.layer AND a.expert = b.expert WHERE b.token > 0 GROUP BY b.layer")
def adjacent_overlap(spark, sf_dir):
    return rounded(stats.adjacent_overlap(derive.trace_wide(spark, sf_dir)), "overlap")


@query(f"WITH {TRACE_SQL} SELECT b.layer, a.expert AS prev_expert, b.expert, count(*) AS n FROM trace a JOIN trace b ON a.token = b.token AND b.layer = a.layer + 1 GROUP BY ALL")
def layer_transitions(spark, sf_dir):
    return stats.transitions(derive.trace_wide(spark, sf_dir))


@query(f"""WITH {TRACE_SQL}, {N_SQL}, u AS ({" UNION ALL ".join(_UNION.format(w=w) for w in (2, 4, 8))}),
g AS (SELECT layer, w, mean_union, least(1 + (SELECT sum(power(0.7::DOUBLE, i)) FROM range(1, w + 1) r(i)), w + 1.0::DOUBLE) AS accepted FROM u)
SELECT layer, w AS depth, round(accepted, 6) AS accepted, round(mean_union / accepted, 6) AS per_accepted, round(4.0::DOUBLE / (mean_union / accepted), 6) AS gain, row_number() OVER (PARTITION BY layer ORDER BY mean_union / accepted, w) = 1 AS best FROM g""")
def speculative_gain(spark, sf_dir):
    u = stats.window_union(derive.trace_wide(spark, sf_dir), [2, 4, 8], n_tokens(spark, sf_dir), TOP_K, EXPERTS)
    return stats.speculative_gain(u, 0.7, TOP_K).withColumns({c: F.round(c, 6) for c in ("accepted", "per_accepted", "gain")})


@query(f"""WITH {TRACE_SQL}, p AS (SELECT *, CASE WHEN token < 100 THEN 'prefill' ELSE 'decode' END AS phase, CASE WHEN token < 100 THEN token ELSE token - 100 END AS t FROM trace),
s AS (SELECT phase, max(t) + 1 AS m FROM p GROUP BY phase)
SELECT phase, layer, round(avg(u), {R}) AS mean_union FROM (SELECT phase, layer, t // 16 AS win, count(DISTINCT expert)::DOUBLE AS u FROM p JOIN s USING (phase) WHERE t < m // 16 * 16 GROUP BY ALL) GROUP BY ALL""")
def phase_width(spark, sf_dir):
    wide, n = derive.trace_wide(spark, sf_dir), n_tokens(spark, sf_dir)
    out = []
    for phase, lo, hi in (("prefill", 0, 100), ("decode", 100, n)):
        part = wide.where((F.col("token") >= lo) & (F.col("token") < hi)).withColumn("token", F.col("token") - lo)
        out.append(stats.window_union(part, [16], hi - lo, TOP_K, EXPERTS).select(F.lit(phase).alias("phase"), "layer", "mean_union"))
    return rounded(out[0].unionByName(out[1]), "mean_union")


# Predictors

_FIT = f"""{TRACE_SQL},
f AS (SELECT layer, expert, count(*) AS n FROM trace WHERE token < {FIT_SQL} GROUP BY ALL),
hot AS (SELECT layer, expert, row_number() OVER (PARTITION BY layer ORDER BY n DESC, expert) AS pos FROM f),
trans AS (SELECT b.layer, a.expert AS prev, b.expert, count(*) AS n FROM trace a JOIN trace b ON a.token = b.token AND b.layer = a.layer + 1 WHERE a.token < {FIT_SQL} GROUP BY ALL),
slots AS (SELECT DISTINCT token, layer FROM trace WHERE token >= {FIT_SQL}),
sticky AS (SELECT s.token, s.layer, t.expert, 0 AS prio, t.rnk::BIGINT AS pos FROM slots s JOIN trace t ON t.token = s.token - 1 AND t.layer = s.layer),
scored AS (SELECT s.token, s.layer, tr.expert, sum(tr.n) AS w FROM slots s JOIN trace t ON t.token = s.token AND t.layer = s.layer - 1 JOIN trans tr ON tr.layer = s.layer AND tr.prev = t.expert GROUP BY ALL),
markov AS (SELECT token, layer, expert, 1 AS prio, row_number() OVER (PARTITION BY token, layer ORDER BY w DESC, expert) AS pos FROM scored),
padding AS (SELECT s.token, s.layer, h.expert, 2 AS prio, h.pos FROM slots s JOIN hot h USING (layer))"""


def _predict_sql(parts: list[str], kind: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {p}" for p in [*parts, "padding"])
    return f"""WITH {_FIT}, pool AS ({union}), firsts AS (SELECT token, layer, expert, min((prio, pos)) AS o FROM pool GROUP BY ALL),
predicted AS (SELECT token, layer, expert, row_number() OVER (PARTITION BY token, layer ORDER BY o, expert) AS r FROM firsts),
hits AS (SELECT s.token, s.layer, b.budget, (SELECT count(*) FROM predicted p JOIN trace t ON t.token = p.token AND t.layer = p.layer AND t.expert = p.expert WHERE p.token = s.token AND p.layer = s.layer AND p.r <= b.budget) AS hit, (SELECT count(*) FROM predicted p WHERE p.token = s.token AND p.layer = s.layer AND p.r <= b.budget) AS size FROM slots s, (VALUES (4), (8), (16)) b(budget))
SELECT '{kind}' AS kind, budget, round(avg(hit / 4.0::DOUBLE), {R}) AS recall, round(avg(hit / size::DOUBLE), {R}) AS precision, count(*) AS samples, round(1 / avg(hit / size::DOUBLE), {R}) AS amplification FROM hits GROUP BY budget"""


def _predict(spark, sf_dir, kind):
    return rounded(predict.evaluate(derive.trace_wide(spark, sf_dir), fit_tokens(spark, sf_dir), (kind,), [4, 8, 16]), "recall", "precision", "amplification")


@query(_predict_sql([], "frequency"))
def predict_frequency(spark, sf_dir):
    return _predict(spark, sf_dir, "frequency")


@query(_predict_sql(["sticky"], "sticky"))
def predict_sticky(spark, sf_dir):
    return _predict(spark, sf_dir, "sticky")


@query(_predict_sql(["markov"], "markov"))
def predict_markov(spark, sf_dir):
    return _predict(spark, sf_dir, "markov")


@query(_predict_sql(["sticky", "markov"], "sticky+markov"))
def predict_sticky_markov(spark, sf_dir):
    return _predict(spark, sf_dir, "sticky+markov")


# Surfaces and layouts

_ASKED = "asked(blob_bytes, queue_depth) AS (VALUES (4096, 1), (65536, 8), (100000, 3), (300000, 6), (1000000, 16), (50000000, 32))"
_NEAR = "(SELECT bytes_per_sec FROM surface s ORDER BY abs(ln({b} / s.blob_bytes::DOUBLE)) + abs(ln({q} / s.queue_depth::DOUBLE)), cell_idx LIMIT 1)"


@query(f"WITH {SURFACE_SQL}, {_ASKED} SELECT blob_bytes::BIGINT AS blob_bytes, queue_depth, arg_min(bytes_per_sec, (round(d, 12), cell_idx)) AS "
    f"bytes_per_sec FROM (SELECT a.blob_bytes, a.queue_depth, s.cell_idx, s.bytes_per_sec, abs(ln(a.blob_bytes / s.blob_bytes::DOUBLE)) + "
        f"abs(ln(a.queue_depth / s.queue_depth::DOUBLE)) AS d FROM asked a, surface s) GROUP BY ALL")
def surface_lookup(spark, sf_dir):
    asked = spark.createDataFrame([(4096, 1), (65536, 8), (100000, 3), (300000, 6), (1000000, 16), (50000000, 32)], "blob_bytes long, queue_depth int")
    return surfaces.lookup(asked, derive.surface(spark))


@query(f"WITH {SURFACE_SQL} SELECT max(bytes_per_sec) AS peak, min(bytes_per_sec) AS worst, round(max(bytes_per_sec) / min(bytes_per_sec), {R}) AS "
    f"spread, arg_max(blob_bytes, bytes_per_sec)::BIGINT AS peak_blob_bytes, arg_max(queue_depth, bytes_per_sec) AS peak_queue_depth FROM surface")
def surface_summary(spark, sf_dir):
    return rounded(surfaces.summary(derive.surface(spark)), "spread")


#: Published rates of I/O engines as (engine, depth, dontcache, GB/s).
ENGINES = [("pread", 1, False, 0.099), ("threads", 4, False, 0.537), ("threads", 8, False, 1.522), ("threads", 16, False, 3.291),
    ("uring-batch", 8, False, 0.550), ("uring-batch", 16, False, 0.816), ("uring-batch", 32, False, 1.086), ("uring-stream", 8, False, 1.362),
    ("uring-stream", 16, False, 1.544), ("uring-stream", 32, False, 1.063), ("uring-stream", 16, True, 0.795), ("uring-stream", 32, True, 0.816)]
_ENGINES = "e(engine, qd, dc, g) AS (VALUES " + ", ".join(f"('{e}', {q}, {str(d).lower()}, {g}::DOUBLE)" for e, q, d, g in ENGINES) + ")"


@query(f"""WITH {_ENGINES}, one AS (SELECT max(g) AS best, max(g) FILTER (engine = 'pread') AS base, max(g) FILTER (engine = 'threads') AS t, max(g) FILTER (engine = 'uring-stream' AND NOT dc) AS u FROM e)
SELECT 'best' AS metric, NULL::INT AS qd, best AS value FROM one UNION ALL SELECT 'base', NULL, base FROM one UNION ALL SELECT 'gain', NULL, round(best / base, {R}) FROM one
UNION ALL SELECT 'recommend', NULL, CASE WHEN t > u * 1.05 THEN 1.0 WHEN u > t * 1.05 THEN -1.0 ELSE 0.0 END::DOUBLE FROM one
UNION ALL SELECT 'batch_vs_stream', a.qd, round((b.g / a.g - 1) * 100, {R}) FROM e a JOIN e b ON a.qd = b.qd AND a.engine = 'uring-batch' AND b.engine = 'uring-stream' AND NOT b.dc
UNION ALL SELECT 'threads_vs_uring', a.qd, round((b.g / a.g - 1) * 100, {R}) FROM e a JOIN e b ON a.qd = b.qd AND a.engine = 'threads' AND b.engine = 'uring-stream' AND NOT b.dc WHERE a.qd IN (8, 16)
UNION ALL SELECT 'dontcache', a.qd, round((b.g / a.g - 1) * 100, {R}) FROM e a JOIN e b ON a.qd = b.qd AND a.engine = 'uring-stream' AND b.engine = 'uring-stream' AND NOT a.dc AND b.dc WHERE a.qd = 16""")
def engine_report(spark, sf_dir):
    return rounded(surfaces.engine_report(spark.createDataFrame(ENGINES, "engine string, qd int, dontcache boolean, gbps double")), "value")


def _layout_sql(gap: int, slot: str = "expert") -> str:
    return f"""WITH {TRACE_SQL}, {SURFACE_SQL}, sl AS (SELECT DISTINCT token, layer, {slot} AS slot FROM trace),
b AS (SELECT *, slot - lag(slot) OVER w AS step FROM sl WINDOW w AS (PARTITION BY token, layer ORDER BY slot)),
shape AS (SELECT token, layer, (sum(CASE WHEN step IS NULL OR step > 1 + {gap} THEN 1 ELSE 0 END) * 3)::BIGINT AS requests, sum(CASE WHEN step IS NULL OR step > 1 + {gap} THEN 1 ELSE step END)::BIGINT * 131072 * 3 AS bytes FROM b GROUP BY ALL),
kinds AS (SELECT DISTINCT requests, bytes FROM shape),
near AS (SELECT requests, bytes, arg_min(bytes_per_sec, (round(abs(ln((bytes // requests) / s.blob_bytes::DOUBLE)) + abs(ln(8 / s.queue_depth::DOUBLE)), 12), cell_idx)) AS bw FROM kinds, surface s GROUP BY ALL)
SELECT layer, round(avg(bytes / bw), 12) AS seconds_per_token, round(avg(bytes), 6) AS bytes_per_token, round(avg(requests), {R}) AS requests_per_token FROM shape JOIN near USING (requests, bytes) GROUP BY layer"""


def _layout_cost(spark, sf_dir, gap, scatter=False):
    wide = derive.trace_wide(spark, sf_dir)
    lay = layout.identity(EXPERTS, wide.select("layer").distinct())
    if scatter:
        lay = lay.select("layer", ((F.col("expert") % 4) * 4 + F.floor(F.col("expert") / 4)).cast("int").alias("slot"), "expert")
    c = layout.cost(layout.shape(layout.slots_of(wide, lay), gap), derive.surface(spark), 131072, 3, 8)
    return c.select("layer", F.round("seconds_per_token", 12).alias("seconds_per_token"), F.round("bytes_per_token", 6).alias("bytes_per_token"),
        F.round("requests_per_token", R).alias("requests_per_token"))


@query(_layout_sql(0))
def layout_cost_identity(spark, sf_dir):
    return _layout_cost(spark, sf_dir, 0)


@query(_layout_sql(2))
def layout_cost_merge_gap(spark, sf_dir):
    return _layout_cost(spark, sf_dir, 2)


@query(_layout_sql(0, "(expert % 4) * 4 + expert // 4"))
def layout_cost_relabelled(spark, sf_dir):
    return _layout_cost(spark, sf_dir, 0, True)


_PAIRS = f"""{TRACE_SQL}, pair AS (SELECT a.layer, a.expert AS ea, b.expert AS eb, count(*) AS n FROM trace a JOIN trace b ON a.token = b.token AND a.layer = b.layer AND a.expert <> b.expert GROUP BY ALL),
grid AS (SELECT l::INT AS layer, a::INT AS ea, b::INT AS eb FROM range(0, {LAYERS}) x(l), range(0, {EXPERTS}) y(a), range(0, {EXPERTS}) z(b)),
co AS (SELECT layer, list(coalesce(n, 0) ORDER BY ea, eb) AS m, arg_min([ea, eb], (-coalesce(n, 0), ea, eb)) FILTER (ea < eb) AS pair_ FROM grid LEFT JOIN pair USING (layer, ea, eb) GROUP BY layer)"""
_ORDER = f"""WITH RECURSIVE {_PAIRS}, run AS (SELECT layer, m, pair_ AS o FROM co UNION ALL
SELECT layer, m, list_append(o, list_min(list_transform(list_filter(range(0, {EXPERTS}), lambda e: NOT list_contains(o, e)), lambda e: struct_pack(near := -m[o[-1] * {EXPERTS} + e + 1], recent := -list_sum(list_transform(o[-4:], lambda x: m[x * {EXPERTS} + e + 1])), id := e))).id::INT)
FROM run WHERE len(o) < {EXPERTS})"""


@query(f"{_ORDER} SELECT layer, unnest(range(0, {EXPERTS}))::INT AS slot, unnest(o) AS expert FROM run WHERE len(o) = {EXPERTS}")
def seriation(spark, sf_dir):
    return layout.seriation(stats.coactivation(derive.trace_wide(spark, sf_dir)), EXPERTS)


@query()
def layout_optimize(spark, sf_dir):
    return layout.optimise(derive.trace_wide(spark, sf_dir), derive.surface(spark), EXPERTS, 131072, passes=3)


@query(_layout_sql(0).replace("SELECT layer, round(avg(bytes / bw), 12) AS seconds_per_token, round(avg(bytes), 6) AS bytes_per_token, round(avg(requests), 9) AS requests_per_token FROM",
    "SELECT layer, 0 AS broken_orders, true AS no_worse, true AS cost_agrees, round(avg(bytes / bw), 12) AS seconds_before FROM"))
def layout_search_invariants(spark, sf_dir):
    """What must hold of searched orders: each is a permutation, costs no more than the identity, and costs what the layout's
    own cost says."""
    wide = derive.trace_wide(spark, sf_dir)
    found = layout.optimise(wide, derive.surface(spark), EXPERTS, 131072, passes=3)
    each = found.groupBy("layer").agg(F.first("seconds_before").alias("before"), F.first("seconds_after").alias("after"))
    broken = layout.check_permutation(found, EXPERTS).select("layer", F.lit(1).alias("bad"))
    costed = layout.cost(layout.shape(layout.slots_of(wide, found.select("layer", "slot", "expert")), 0), derive.surface(spark), 131072, 3, 8).select("layer", "seconds_per_token")
    rows = each.join(broken, "layer", "left").join(costed, "layer")
    return rows.select("layer", F.coalesce("bad", F.lit(0)).alias("broken_orders"), (F.col("after") <= F.col("before")).alias("no_worse"),
        (F.abs(F.col("after") / F.col("seconds_per_token") - 1) < 1e-9).alias("cost_agrees"), F.round("before", 12).alias("seconds_before"))


@query(f"WITH a AS ({_layout_sql(0)}), b AS ({_layout_sql(0, '(expert % 4) * 4 + expert // 4')}), r AS (SELECT layer, a.seconds_per_token / "
    f"b.seconds_per_token AS s FROM a JOIN b USING (layer)) SELECT layer, round(s, 6) AS speedup, s >= 1.05 AS worth_repacking FROM r")
def layout_speedup(spark, sf_dir):
    return layout.speedup(_layout_cost(spark, sf_dir, 0), _layout_cost(spark, sf_dir, 0, True)).withColumn("speedup", F.round("speedup", 6))


# Caches

_DIST = f"""WITH {LOG_SQL}, p AS (SELECT *, lag(seq) OVER k AS prev_seq, lead(seq) OVER k AS next_seq FROM log WINDOW k AS (PARTITION BY key ORDER BY seq)),
d AS (SELECT a.seq, count(b.seq) AS distance FROM p a LEFT JOIN p b ON b.seq > a.prev_seq AND b.seq < a.seq AND (b.next_seq IS NULL OR b.next_seq >= a.seq) WHERE a.prev_seq IS NOT NULL GROUP BY a.seq)"""


@query(f"{_DIST} SELECT p.seq, p.key, p.prev_seq, d.distance FROM p LEFT JOIN d USING (seq)")
def reuse_distance(spark, sf_dir):
    """With far smaller blocks than usual, so that all parts of the count have rows."""
    return cache.reuse_distance(derive.access_log(spark, sf_dir), 500)


def _configs(spark, policies, slots):
    return spark.createDataFrame([(p, s * 1000, cache.PROTECTED) for p in policies for s in slots], "policy string, capacity long, protected_share double")


def _log(spark, sf_dir):
    return derive.access_log(spark, sf_dir).select("seq", "key", F.lit(1000).cast("long").alias("bytes"), F.lit(1.0).alias("cost"))


@query(f"{_DIST} SELECT slots, count(*) FILTER (distance < slots) AS hits, count(*) FILTER (distance IS NULL OR distance >= slots) AS misses, "
    f"round(count(*) FILTER (distance < slots) / count(*)::DOUBLE, {R}) AS hit_rate FROM p LEFT JOIN d USING (seq), (VALUES (10), (40), (100)) s(slots) GROUP BY slots")
def lru_hit_rate(spark, sf_dir):
    r = cache.simulate(_log(spark, sf_dir), _configs(spark, ["lru"], [10, 40, 100]))
    return rounded(r.select((F.col("capacity") / 1000).cast("int").alias("slots"), "hits", "misses", "hit_rate"), "hit_rate")


@query(f"WITH {LOG_SQL}, c AS (SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) AS r FROM log GROUP BY key) SELECT slots, "
    f"round(sum(CASE WHEN r <= slots THEN n ELSE 0 END) / sum(n)::DOUBLE, {R}) AS hit_rate FROM c, (VALUES (10), (40), (100)) s(slots) GROUP BY slots")
def offline_optimal_hit_rate(spark, sf_dir):
    return rounded(cache.offline_optimum(derive.access_log(spark, sf_dir), [10, 40, 100]), "hit_rate")


def _policy(spark, sf_dir, policy):
    return rounded(cache.simulate(_log(spark, sf_dir), _configs(spark, [policy], [10, 40, 100])), "hit_rate")


_ENTRY = "STRUCT(p BOOLEAN, s DOUBLE, k BIGINT, h BIGINT)[]"  # protected, score, key, hits: the least is the victim


def _policy_sql(policy: str) -> str:
    """The policy access by access, as a recursion over the log; every entry has size 1000 and cost 1."""
    score = {"lfu": "({h})::DOUBLE", "gdsf": "level + ({h}) * 1.0::DOUBLE / 1000", "slru": "(i + 1)::DOUBLE"}[policy]
    slru = str(policy == "slru").lower()
    again = f"struct_pack(p := {slru}, s := {score.format(h='e.h + 1')}, k := e.k, h := e.h + 1)"
    return f"""WITH RECURSIVE {LOG_SQL}, keys AS (SELECT list(key ORDER BY seq) AS keys, count(*) AS n FROM log),
run AS (
  SELECT slots, 0::BIGINT AS i, 0::BIGINT AS hits, 0::BIGINT AS evictions, 0::DOUBLE AS clock, []::{_ENTRY} AS st FROM (VALUES (10), (40), (100)) s(slots)
  UNION ALL
  SELECT slots, i + 1, hits + hit::BIGINT, evictions + full_::BIGINT, level,
    CASE WHEN {slru} AND len(list_filter(st2, lambda e: e.p)) > 0.8::DOUBLE * slots
      THEN list_transform(st2, lambda e: CASE WHEN e.k = least_safe.k THEN struct_pack(p := false, s := e.s, k := e.k, h := e.h) ELSE e END) ELSE st2 END
  FROM (SELECT *, list_min(list_filter(st2, lambda e: e.p)) AS least_safe FROM (SELECT *, CASE WHEN hit THEN list_transform(st, lambda e: CASE WHEN e.k = key THEN {again} ELSE e END)
      ELSE list_append(CASE WHEN full_ THEN list_filter(st, lambda e: e.k <> victim.k) ELSE st END, struct_pack(p := false, s := {score.format(h='1')}, k := key, h := 1::BIGINT)) END AS st2
    FROM (SELECT *, CASE WHEN full_ AND '{policy}' = 'gdsf' THEN greatest(clock, victim.s) ELSE clock END AS level
      FROM (SELECT *, NOT hit AND len(st) >= slots AS full_, list_min(st) AS victim
        FROM (SELECT run.*, keys[i + 1] AS key, len(list_filter(st, lambda e: e.k = keys[i + 1])) > 0 AS hit FROM run, keys WHERE i < n))))))
SELECT '{policy}' AS policy, slots * 1000::BIGINT AS capacity, {cache.PROTECTED}::DOUBLE AS protected_share, hits, n - hits AS misses, evictions, (n - hits) * 1000 AS bytes_fetched, (n - hits)::DOUBLE AS fetch_seconds, round(hits / n::DOUBLE, {R}) AS hit_rate
FROM run, keys WHERE i = n"""


@query(_policy_sql("lfu"))
def cache_policy_lfu(spark, sf_dir):
    return _policy(spark, sf_dir, "lfu")


@query(_policy_sql("gdsf"))
def cache_policy_gdsf(spark, sf_dir):
    return _policy(spark, sf_dir, "gdsf")


@query(_policy_sql("slru"))
def cache_policy_slru(spark, sf_dir):
    return _policy(spark, sf_dir, "slru")


def _replay_inputs(spark):
    sizes = spark.createDataFrame([(layer, e, 131072 * 3) for layer in range(LAYERS) for e in range(EXPERTS)], "layer int, expert int, bytes long")
    asked = spark.createDataFrame([(131072 * 3, 1), (131072 * 3, 8)], "blob_bytes long, queue_depth int")
    charged = surfaces.lookup(asked, derive.surface(spark)).select(F.col("blob_bytes").alias("bytes"), "queue_depth", surfaces.charge(F.col("blob_bytes"), F.col("bytes_per_sec")).alias("seconds"))
    return sizes, charged


#: What each configuration of the replay moves and how long that takes, step by step: guesses come before uses.
_REPLAY = f"""WITH RECURSIVE {_FIT}, {SURFACE_SQL}, pool AS (SELECT * FROM sticky UNION ALL SELECT * FROM markov UNION ALL SELECT * FROM padding),
firsts AS (SELECT token, layer, expert, min((prio, pos)) AS o FROM pool GROUP BY ALL),
guessed AS (SELECT * FROM (SELECT token, layer, expert, row_number() OVER (PARTITION BY token, layer ORDER BY o, expert) AS r FROM firsts) WHERE r <= 4),
c AS (SELECT max(CASE WHEN q = 1 THEN s END) AS c1, max(CASE WHEN q = 8 THEN s END) AS c8 FROM (SELECT q, 393216 / arg_min(bytes_per_sec, (round(abs(ln(393216 / blob_bytes::DOUBLE)) + abs(ln(q / queue_depth::DOUBLE)), 12), cell_idx)) AS s FROM surface, (VALUES (1), (8)) d(q) GROUP BY q)),
steps AS (SELECT token, layer, false AS used, r AS pos, expert, EXISTS (SELECT 1 FROM trace t WHERE t.token = g.token AND t.layer = g.layer AND t.expert = g.expert) AS right_ FROM guessed g
  UNION ALL SELECT token, layer, true, rnk, expert, true FROM trace WHERE token >= {FIT_SQL}),
ops AS (SELECT list(struct_pack(used := used, k := (layer * 16 + expert)::BIGINT, fresh := NOT used AND pos = 1, right_ := right_) ORDER BY token, layer, used, pos) AS ops, count(*) AS n, count(DISTINCT token) AS tokens FROM steps),
run AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS hits, 0::BIGINT AS misses, 0::BIGINT AS useful, 0::BIGINT AS wasted, 0::BIGINT AS requests, 0::DOUBLE AS seconds, 0::DOUBLE AS fetched, 0::DOUBLE AS clock, []::BIGINT[] AS flying, []::{_ENTRY} AS st
  UNION ALL
  SELECT i + 1, hits + (op.used AND hit)::BIGINT, misses + (op.used AND NOT hit)::BIGINT, useful + (op.used AND hit AND list_contains(flying, op.k))::BIGINT, wasted + (NOT op.used AND NOT hit AND NOT op.right_)::BIGINT,
    requests + (NOT hit)::BIGINT, seconds + CASE WHEN hit THEN 0 WHEN op.used THEN c1 ELSE c8 END, fetched + CASE WHEN op.used AND NOT hit THEN c8 ELSE 0 END, level,
    CASE WHEN op.used OR hit THEN flown ELSE list_append(flown, op.k) END,
    CASE WHEN hit AND NOT op.used THEN st
      WHEN hit THEN list_transform(st, lambda e: CASE WHEN e.k = op.k THEN struct_pack(p := false, s := level + (e.h + 1) * c8 / 393216, k := e.k, h := e.h + 1) ELSE e END)
      ELSE list_append(CASE WHEN full_ THEN list_filter(st, lambda e: e.k <> victim.k) ELSE st END, struct_pack(p := false, s := level + 1 * c8 / 393216, k := op.k, h := 1::BIGINT)) END
  FROM (SELECT *, CASE WHEN full_ THEN greatest(clock, victim.s) ELSE clock END AS level, CASE WHEN op.fresh THEN [] ELSE flying END AS flown
    FROM (SELECT *, NOT hit AND len(st) >= 32 AS full_, list_min(st) AS victim
      FROM (SELECT run.*, c1, c8, ops[i + 1] AS op, len(list_filter(st, lambda e: e.k = ops[i + 1].k)) > 0 AS hit FROM run, ops, c WHERE i < n))))
SELECT 0 AS config, 'gdsf' AS policy, 'sticky+markov' AS predictor, 4 AS budget, tokens, hits, misses, round(hits / (hits + misses)::DOUBLE, {R}) AS hit_rate, round(requests * 393216 / tokens::DOUBLE, 3) AS bytes_per_token, round(requests / tokens::DOUBLE, {R}) AS requests_per_token,
  round(seconds / tokens, {R}) AS seconds_per_token, round(fetched, {R}) AS cache_fetch_seconds, useful, wasted, round(useful / (useful + wasted)::DOUBLE, {R}) AS prefetch_precision, round(requests * 393216 / seconds, 0) AS effective_bps, round(1 / (seconds / tokens), 4) AS tokens_per_second, true AS calibrated
FROM run, ops WHERE i = n"""


@query(_REPLAY)
def replay_default(spark, sf_dir):
    sizes, charged = _replay_inputs(spark)
    out = replay.run(derive.trace_wide(spark, sf_dir), sizes, charged, fit_tokens(spark, sf_dir),
        [{"policy": "gdsf", "predictor": "sticky+markov", "budget": 4, "cache_bytes": 12 << 20, "queue_depth": 8}])
    digits = {"bytes_per_token": 3, "effective_bps": 0, "tokens_per_second": 4}
    return out.withColumns({c: F.round(c, digits.get(c, R)) for c, kind in out.dtypes if kind == "double"})


@query()
def replay_sweep(spark, sf_dir):
    sizes, charged = _replay_inputs(spark)
    return replay.run(derive.trace_wide(spark, sf_dir), sizes, charged, fit_tokens(spark, sf_dir), replay.sweep_configs(TOP_K, 12 << 20, 8))


# Codecs and allocation

_HALF = "CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} / power(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14) - 10), 0) * power(2.0::DOUBLE, greatest(floor(log2(abs({x}))), -14) - 10) END"


def _roundtrip_sql() -> str:
    cells = []
    for name, _, bits, symmetric in scalars.NATIVE_TYPES:
        levels = (1 << bits) - 1
        if symmetric:
            d = _HALF.format(x="(top / 127)")
            cells.append(f"SELECT vec_id, '{name}' AS name, v, CASE WHEN top > 0 THEN greatest(-127.0::DOUBLE, least(127.0::DOUBLE, sign(v) * "
                f"floor(abs(v * (127.0::DOUBLE / top)) + 0.5))) * ({d}) ELSE 0 END AS y FROM g")
        else:
            lo, d = _HALF.format(x="lo"), _HALF.format(x=f"((hi - lo) / {levels}.0::DOUBLE)")
            cells.append(f"SELECT vec_id, '{name}' AS name, v, l + d * CASE WHEN d > 0 THEN greatest(0.0::DOUBLE, least({levels}.0::DOUBLE, sign((v - "
                f"l) / d) * floor(abs((v - l) / d) + 0.5))) ELSE 0 END AS y FROM (SELECT *, {lo} AS l, {d} AS d FROM g)")
    return f"v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT *, max(abs(v)) OVER k AS top, min(v) OVER k AS lo, max(v) OVER k AS hi FROM v WINDOW k AS (PARTITION BY vec_id)), y AS ({' UNION ALL '.join(cells)})"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("values"))


@query(f"WITH {_roundtrip_sql()} SELECT vec_id AS key, name, round(sqrt(avg((v - y) * (v - y))), 8) AS rmse FROM y GROUP BY ALL")
def quant_roundtrip_rmse(spark, sf_dir):
    return codec.rmse_table(_vectors(spark, sf_dir)).withColumn("rmse", F.round("rmse", 8))


@query(f"WITH {_roundtrip_sql()} SELECT name, count(*) AS n, round(sqrt(avg((v - y) * (v - y))), 6) AS rmse, round(max(abs(v - y)), 6) AS max_abs, "
    f"round(sqrt(avg((v - y) * (v - y))) / sqrt(avg(v * v)), 6) AS rel_rmse, round(corr(v, y), 6) AS corr FROM y GROUP BY name")
def tensor_agreement(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(n).alias("key"), codec.roundtrip(F.col("values"), n).alias("y")) for n in codec.BITS])
    pairs = v.select("values", F.inline(rows)).select("key", F.inline(F.arrays_zip(F.col("values").alias("a"), F.col("y").alias("b")))).toDF("key", "a", "b")
    out = model.agreement(pairs)
    return out.select(F.col("key").alias("name"), "n", *[F.round(c, 6).alias(c) for c in ("rmse", "max_abs", "rel_rmse", "corr")])


@query("WITH t(name, tag, bits, group_bytes) AS (VALUES ('Q8', 0, 8, 66), ('Q5', 1, 5, 44), ('Q4', 2, 4, 36), ('Q3', 3, 3, 28), ('Q2', 4, 2, 20)) "
    "SELECT name, tag, bits, group_bytes, group_bytes * 8 / 64.0::DOUBLE AS bits_per_weight, (1048576 // 64 * group_bytes)::BIGINT AS bytes, "
        "ceil(1048576 * (group_bytes * 8 / 64.0::DOUBLE) / 8)::BIGINT AS bytes_at FROM t")
def quantised_size(spark, sf_dir):
    t = scalars.native_types(spark)
    return t.select("name", "tag", "bits", "group_bytes", "bits_per_weight",
        (F.lit(1048576 // 64) * F.col("group_bytes")).cast("long").alias("bytes"),
        scalars.bytes_at(F.lit(1048576), F.col("bits_per_weight")).alias("bytes_at"))


@query("WITH t(ord, name, b) AS (VALUES (0, 'Q8', 8.25), (1, 'Q5', 5.5), (2, 'Q4', 4.5), (3, 'Q3', 3.5), (4, 'Q2', 2.5)), a(bits) AS (VALUES (1.0), "
    "(2.625), (3.0), (4.0), (4.5), (5.0), (6.5625), (16.0)) SELECT bits::DOUBLE AS bits, arg_min(name, (abs(bits - b), ord)) AS name FROM a, t GROUP BY bits")
def nearest_bits(spark, sf_dir):
    asked = spark.createDataFrame([(x,) for x in (1.0, 2.625, 3.0, 4.0, 4.5, 5.0, 6.5625, 16.0)], "bits double")
    t = F.broadcast(scalars.native_types(spark).agg(F.collect_list(F.struct("ord", "name", "bits_per_weight")).alias("t")))  # one row
    best = F.array_min(F.transform("t", lambda x: F.struct(F.abs(x["bits_per_weight"] - F.col("bits")).alias("d"), x["ord"].alias("o"), x["name"].alias("n"))))
    return asked.join(t).select("bits", best["n"].alias("name"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS l1, round(max_v - min_v, 8) AS spread FROM (SELECT "
    "*, list_max(embedding)::DOUBLE AS max_v, list_min(embedding)::DOUBLE AS min_v FROM embeddings)")
def weight_extremes(spark, sf_dir):
    v = F.col("values")
    l1 = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    return _vectors(spark, sf_dir).select(F.col("key").alias("vec_id"), F.round(l1, 6).alias("l1"), F.round(F.array_max(v) - F.array_min(v), 8).alias("spread"))


@query(f"WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT count(*) AS n, round(sum({_HALF.format(x='v')}), 6) AS "
    f"total, round(max(abs(v - ({_HALF.format(x='v')}))), 10) AS worst FROM v")
def half_precision(spark, sf_dir):
    v = _vectors(spark, sf_dir).select(F.explode("values").alias("v"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(scalars.half(F.col("v"))), 6).alias("total"), F.round(F.max(F.abs(F.col("v") - scalars.half(F.col("v")))), 10).alias("worst"))


@query("WITH b AS (SELECT lang AS key, unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')) AS h FROM documents), c AS "
    "(SELECT key, h, count(*)::DOUBLE AS n FROM b WHERE h <> '' GROUP BY ALL) SELECT key, sum(n)::BIGINT AS n_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY key")
def byte_entropy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("key"), F.col("text").cast("binary").alias("data"))
    return stats.byte_entropy(d).withColumn("entropy", F.round("entropy", 6))


@query(f"{_RANKED} SELECT layer, expert, n, r <= 5 AS resident FROM h")
def residency_prefix(spark, sf_dir):
    return allocate.residents(_freq(spark, sf_dir), 100_000, 599_999)


def _freq(spark, sf_dir):
    return stats.frequency(derive.trace_wide(spark, sf_dir).select("layer", F.explode("experts").alias("expert")))


@query(f"{_RANKED} SELECT layer, round(sum(CASE WHEN r <= 5 THEN n ELSE 0 END) / sum(n)::DOUBLE, {R}) AS hit_rate FROM h GROUP BY layer")
def planned_hit_rate(spark, sf_dir):
    return rounded(allocate.hit_rate(allocate.residents(_freq(spark, sf_dir), 100_000, 599_999)), "hit_rate")


_SENS = "sens AS (SELECT ((vec_id % 64) // 16)::INT AS layer, (vec_id % 16)::INT AS expert, i::INT AS ord, [8.25, 4.5, 2.5][i + 1]::DOUBLE AS bits, avg(abs(embedding[i + 1])::DOUBLE) AS error FROM embeddings, range(0, 3) r(i) GROUP BY ALL)"


def _mean_sens(spark, sf_dir):
    """Mean finite error per layer, expert and precision over all embeddings, dealt by vec_id modulo 64."""
    e = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.pmod("vec_id", F.lit(LAYERS * EXPERTS)))
    return allocate.finite(_errors(e)).groupBy("layer", "expert", "ord", "bits").agg(F.avg("error").alias("error"))


def _errors(e):
    bits = F.array(F.lit(8.25), F.lit(4.5), F.lit(2.5))
    rows = F.transform(F.slice("embedding", 1, 3), lambda x, i: F.struct(i.alias("ord"), F.get(bits, i).alias("bits"), F.abs(x).cast("double").alias("error")))
    return e.select(F.expr("vec_id div 16").cast("int").alias("layer"), (F.col("vec_id") % 16).cast("int").alias("expert"), F.inline(rows))


@query(f"WITH {TRACE_SQL}, {_SENS}, f AS (SELECT layer, expert, count(*) AS n FROM trace GROUP BY ALL), l AS (SELECT f.layer, f.expert, f.n, "
    f"b.at_bits, arg_min(s.error, (abs(s.bits - b.at_bits), s.ord)) AS loss FROM f, (VALUES (3.0::DOUBLE), (5.5::DOUBLE)) b(at_bits), sens s WHERE "
        f"s.layer = f.layer AND s.expert = f.expert GROUP BY ALL) SELECT layer, at_bits, round(sum(n / (SELECT count(*) FROM embeddings)::DOUBLE * loss), {R}) AS expected FROM l GROUP BY ALL")
def weighted_loss(spark, sf_dir):
    asked = _freq(spark, sf_dir).withColumn("at_bits", F.explode(F.array(F.lit(3.0), F.lit(5.5))))
    lost = allocate.loss_at(asked, _mean_sens(spark, sf_dir))
    n = n_tokens(spark, sf_dir)
    return lost.groupBy("layer", "at_bits").agg(F.round(F.sum(F.col("n") / F.lit(float(n)) * F.col("loss")), R).alias("expected"))


_RUNGS = [(8.25, "keep"), *sorted((r for r in allocate.LADDER if r[0] < 8.25), reverse=True)]
#: The greedy demotion, step by step: per layer where each expert stands on the ladder, and the loss so far.
_ALLOCATION = f"""WITH RECURSIVE {TRACE_SQL}, {_SENS}, f AS (SELECT layer, expert, count(*) AS n FROM trace GROUP BY ALL),
g AS (SELECT l::INT AS layer, e::INT AS expert, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY l ORDER BY coalesce(n, 0) DESC, e) <= 7 AS resident FROM range(0, {LAYERS}) x(l) CROSS JOIN range(0, {EXPERTS}) y(e) LEFT JOIN f ON layer = l AND expert = e),
rung(k, bits, label) AS (VALUES {", ".join(f"({k}, {b}::DOUBLE, '{name}')" for k, (b, name) in enumerate(_RUNGS))}),
r AS (SELECT g.*, k, bits, label, n / (SELECT count(*) FROM embeddings)::DOUBLE AS rate, ceil(4194304 * bits / 8) AS size, ceil(4194304 * bits / 8) / CASE WHEN resident THEN {allocate.RESIDENT_BPS} ELSE {allocate.STORAGE_BPS} END::DOUBLE AS seconds,
  (SELECT arg_min(s.error, (abs(s.bits - rung.bits), s.ord)) FROM sens s WHERE s.layer = g.layer AND s.expert = g.expert) AS loss FROM g, rung),
t AS (SELECT layer, list(struct_pack(rate := rate, seconds := seconds, loss := loss) ORDER BY expert, k) AS c, sum(rate * loss) FILTER (bits = 4.5) AS ceiling, sum(rate * loss) FILTER (k = 0) AS loss0 FROM r GROUP BY layer),
run AS (
  SELECT layer, c, ceiling, loss0 AS now, list_transform(range(0, {EXPERTS}), lambda e: 0::BIGINT) AS st, false AS over_ FROM t
  UNION ALL
  SELECT layer, c, ceiling, CASE WHEN pick IS NULL THEN now ELSE now + pick.added END, CASE WHEN pick IS NULL THEN st ELSE list_transform(st, lambda x, i: CASE WHEN i - 1 = pick.e THEN x + 1 ELSE x END) END, pick IS NULL
  FROM (SELECT *, list_min(list_filter(list_transform(list_filter(range(0, {EXPERTS}), lambda e: st[e + 1] + 1 < {len(_RUNGS)}), lambda e: struct_pack(
      costly := CASE WHEN c[e * {len(_RUNGS)} + st[e + 1] + 2].loss <= c[e * {len(_RUNGS)} + st[e + 1] + 1].loss OR c[e * {len(_RUNGS)} + 1].rate = 0 THEN 0 ELSE 1 END,
      gain := CASE WHEN c[e * {len(_RUNGS)} + st[e + 1] + 2].loss <= c[e * {len(_RUNGS)} + st[e + 1] + 1].loss OR c[e * {len(_RUNGS)} + 1].rate = 0 THEN 0 ELSE
        -(c[e * {len(_RUNGS)} + 1].rate * (c[e * {len(_RUNGS)} + st[e + 1] + 1].seconds - c[e * {len(_RUNGS)} + st[e + 1] + 2].seconds)) / (c[e * {len(_RUNGS)} + 1].rate * (c[e * {len(_RUNGS)} + st[e + 1] + 2].loss - c[e * {len(_RUNGS)} + st[e + 1] + 1].loss)) END,
      e := e, added := c[e * {len(_RUNGS)} + 1].rate * (c[e * {len(_RUNGS)} + st[e + 1] + 2].loss - c[e * {len(_RUNGS)} + st[e + 1] + 1].loss))), lambda x: x.costly = 0 OR now + x.added <= ceiling)) AS pick
    FROM run WHERE NOT over_)),
chosen AS (SELECT layer, unnest(range(0, {EXPERTS}))::INT AS expert, unnest(st) AS k FROM run WHERE over_)
SELECT layer, expert, n AS freq, CASE WHEN resident THEN 'resident' ELSE 'storage' END AS tier, bits, label, size::BIGINT AS bytes FROM chosen JOIN r USING (layer, expert, k)"""


@query(_ALLOCATION)
def bit_allocation(spark, sf_dir):
    config = allocate.Config(weights_per_expert=4 << 20, resident_budget=8 * (4 << 20), baseline_bits=8.25, error_budget=("uniform", 4.5), require_protection=False)
    plan = allocate.allocate(stats.frequency(derive.trace(spark, sf_dir), EXPERTS), _mean_sens(spark, sf_dir), n_tokens(spark, sf_dir), config)
    return plan.select("layer", "expert", "freq", "tier", "bits", "label", "bytes")


@query(f"WITH plan AS ({_ALLOCATION.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}) SELECT layer, bool_or(bits < 8.25) AS demoted FROM plan GROUP BY layer")
def allocation_demoted(spark, sf_dir):
    return allocate.demoted_any(bit_allocation(spark, sf_dir), 8.25)


@query("WITH t(ord, name, b) AS (VALUES " + ", ".join(f"({i}, '{n}', {scalars.group_bytes(n) / 8}::DOUBLE)" for i,
    (n, *_) in enumerate(scalars.NATIVE_TYPES)) + ") SELECT vec_id, arg_min(name, (abs(1 + 8 * abs(embedding[1]::DOUBLE) - b), ord)) AS type FROM embeddings, t GROUP BY vec_id")
def nearest_native_type(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", allocate.nearest_native(1 + 8 * F.abs(F.get("embedding", 0).cast("double"))).alias("type"))


@query("SELECT CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 4 END::INT AS ty, count(*) AS n, sum(CASE WHEN vec_id % 2 = 0 THEN 36 ELSE 20 END)::BIGINT AS bytes FROM embeddings GROUP BY 1")
def precision_mix(spark, sf_dir):
    """What a store written from all embeddings holds of each type."""
    from ..sources import store

    return store.precision_mix(store_file_round_trip(spark, sf_dir))


_SIZES = "sizes AS (SELECT lang AS key, sum(octet_length(encode(text)))::BIGINT AS n FROM documents GROUP BY lang)"


@query(f"""WITH {_SIZES} SELECT key, n, CASE WHEN n >= power(2, 40) THEN printf('%.2f TiB', n / power(2, 40)) WHEN n >= power(2, 30) THEN printf('%.2f GiB', n / power(2, 30)) WHEN n >= power(2, 20) THEN printf('%.2f MiB', n / power(2, 20)) WHEN n >= 1024 THEN printf('%.2f KiB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS human,
round(n / {allocate.RESIDENT_BPS}::DOUBLE, 12) AS resident_seconds, round(n / {allocate.STORAGE_BPS}::DOUBLE, 12) AS storage_seconds, round({allocate.RESIDENT_BPS}::DOUBLE / {allocate.STORAGE_BPS}::DOUBLE, {R}) AS penalty FROM sizes""")
def tier_costs(spark, sf_dir):
    """Bytes of text by language, read at each tier's rate."""
    n, fast, slow = F.col("n"), F.lit(allocate.RESIDENT_BPS), F.lit(allocate.STORAGE_BPS)
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("key")).agg(F.sum(F.octet_length("text")).alias("n"))
    return sizes.select("key", "n", scalars.human(n).alias("human"), F.round(scalars.tier_seconds(n, fast), 12).alias("resident_seconds"),
        F.round(scalars.tier_seconds(n, slow), 12).alias("storage_seconds"), F.round(scalars.storage_penalty(fast, slow), R).alias("penalty"))


_COUNTERS = "c AS (SELECT vec_id AS id, (vec_id * 37 % 101)::BIGINT AS cached, (vec_id % 97)::BIGINT AS recently_evicted, (vec_id % 3 * 101)::BIGINT AS pages FROM embeddings)"


@query(f"WITH {_COUNTERS} SELECT id, round(CASE WHEN pages > 0 THEN cached / pages::DOUBLE ELSE 0 END, {R}) AS cached_fraction, recently_evicted > 0 AS thrashing FROM c")
def page_residency(spark, sf_dir):
    v = F.col("vec_id")
    counters = table(spark, sf_dir, "embeddings").select(v.alias("id"), (v * 37 % 101).alias("cached"), (v % 97).alias("recently_evicted"), (v % 3 * 101).alias("pages"))
    return rounded(surfaces.residency(counters), "cached_fraction").select("id", "cached_fraction", "thrashing")


@query(f"WITH {SURFACE_SQL} SELECT blob_bytes::BIGINT AS blob_bytes, arg_min(queue_depth, (-bytes_per_sec, queue_depth)) AS queue_depth, "
    f"max(bytes_per_sec) AS bytes_per_sec FROM surface GROUP BY blob_bytes")
def best_depth(spark, sf_dir):
    return surfaces.first_best(derive.surface(spark), ["blob_bytes"], "bytes_per_sec", ["queue_depth"]).select("blob_bytes", "queue_depth", "bytes_per_sec")


# Models

_MODELS = "m(model, data_bytes, params, ram_bytes, ctx) AS (VALUES ('a', 10988027904::BIGINT, 8000000000::BIGINT, 8332236226::BIGINT, 4096::BIGINT), ('b', 10988027904::BIGINT, 8000000000::BIGINT, 17179869184::BIGINT, 8192::BIGINT), ('c', 32000000000::BIGINT, 30500000000::BIGINT, 17179869184::BIGINT, 4096::BIGINT))"
_FITS = f"{_MODELS}, f AS (SELECT *, (419430400 + ctx * 131072)::BIGINT AS reserve, floor(ram_bytes * 0.95::DOUBLE)::BIGINT AS ceiling FROM m)"


def _models(spark):
    rows = [("a", 10988027904, 8000000000, 8332236226, 4096), ("b", 10988027904, 8000000000, 17179869184, 8192), ("c", 32000000000, 30500000000, 17179869184, 4096)]
    return model.fit(spark.createDataFrame(rows, "model string, data_bytes long, params long, ram_bytes long, ctx long"))


@query(f"WITH {_FITS} SELECT model, reserve, data_bytes + reserve AS projected, ceiling, data_bytes + reserve <= ceiling AS fits, greatest(0, ceiling - reserve) AS max_weights FROM f")
def fit_check(spark, sf_dir):
    return _models(spark).select("model", "reserve", "projected", "ceiling", "fits", "max_weights")


_TIERS = "t(ord, tier, bpw) AS (VALUES " + ", ".join(f"({i}, '{n}', {b}::DOUBLE)" for i, (n, b) in enumerate(scalars.QUANT_TIERS)) + ")"


@query(f"WITH {_FITS}, {_TIERS} SELECT model, tier, floor(params * bpw / 8)::BIGINT AS weight_bytes, floor(params * bpw / 8) <= greatest(0, ceiling - reserve) AS tier_fits FROM f, t")
def fit_table(spark, sf_dir):
    return model.fit_table(_models(spark)).select("model", "tier", "weight_bytes", "tier_fits")


@query(f"WITH {_FITS}, {_TIERS}, x AS (SELECT model, ord, tier, floor(params * bpw / 8)::BIGINT AS w, floor(params * bpw / 8) <= greatest(0, ceiling "
    f"- reserve) AS ok FROM f, t) SELECT model, arg_max(tier, ord) FILTER (ok) AS tier, max(w) FILTER (ok) AS weight_bytes FROM x GROUP BY model")
def recommend_quant(spark, sf_dir):
    return model.recommend(model.fit_table(_models(spark)), ["model"])


#: A small header: one good block, one whose router disagrees, one tensor without a block, and one of no mixture.
TENSORS = [
    (0, "blk.0.ffn_gate_exps.weight", [64, 128, 32], 12, 147456), (1, "blk.0.ffn_up_exps.weight", [64, 128, 32], 12, 147456),
        (2, "blk.0.ffn_down_exps.weight", [128, 64, 32], 14, 215040), (3, "blk.0.ffn_gate_inp.weight", [64, 32], 0, 8192),
    (4, "blk.1.ffn_gate_exps.weight", [64, 128, 32], 1, 524288), (5, "blk.1.ffn_gate_inp.weight", [64, 16], 0, 4096),
        (6, "ffn_up_exps.stray", [64, 8], 1, 1024), (7, "token_embd.weight", [64, 256], 1, 32768),
]
_TENSORS = "t(idx, name, dims, ggml_type, nbytes) AS (VALUES " + ", ".join(f"({i}, '{n}', {d}::BIGINT[], {k}, {b}::BIGINT)" for i, n, d, k, b in TENSORS) + ")"
_TYPES = "y(ggml_type, type_name, block_elems, block_bytes) AS (VALUES " + ", ".join(f"({i}, '{n}', {e}, {b})" for i, n, e, b in scalars.GGML_TYPES) + ")"
_MOE = f"""{_TENSORS}, {_TYPES}, x AS (SELECT t.*, type_name, list_product(dims)::BIGINT AS n, block_bytes * 8.0::DOUBLE / block_elems AS bpw, regexp_matches(name, 'ffn_(gate|up|down)_exps') AS e, regexp_extract(name, '^blk\\.(\\d+)\\.', 1) AS b, dims[-1] AS last FROM t JOIN y USING (ggml_type) WHERE regexp_matches(name, 'ffn_(gate|up|down)_exps|ffn_gate_inp|exp_probs_b')),
z AS (SELECT *, max(last) OVER (PARTITION BY b) AS ne FROM x)"""


def _tensors(spark):
    return spark.createDataFrame(TENSORS, "idx int, name string, dims array<bigint>, ggml_type int, nbytes long")


@query(f"""WITH {_MOE} SELECT b::INT AS block, ne::BIGINT AS n_experts, string_agg(name, ',' ORDER BY idx) AS tensors, sum(nbytes // ne) FILTER (e)::BIGINT AS bytes_per_expert, max(nbytes // ne) FILTER (e)::BIGINT AS slice_bytes, sum(n // ne) FILTER (e)::BIGINT AS weights_per_expert,
round(sum(nbytes) FILTER (e) * 8.0::DOUBLE / sum(n) FILTER (e), {R}) AS baseline_bits, min(bpw) FILTER (e) AS min_baseline_bits, arg_max(type_name, (nbytes, -idx)) FILTER (e) AS baseline_type FROM z WHERE b <> '' GROUP BY b, ne HAVING bool_and(last = ne AND nbytes % ne = 0) AND bool_or(e)""")
def moe_layers(spark, sf_dir):
    m = model.moe_layers(_tensors(spark)).withColumn("tensors", F.array_join("tensors", ","))
    return rounded(m.drop("expert_tensors"), "baseline_bits")


@query(f"WITH {_MOE} SELECT name, CASE WHEN b = '' THEN 'no block' ELSE 'expert count differs' END AS reason FROM z WHERE b = '' OR last <> ne")
def moe_skipped(spark, sf_dir):
    return model.moe_skipped(_tensors(spark))


@query(f"WITH {_TENSORS}, {_TYPES} SELECT name, list_product(dims)::BIGINT AS n_elements, block_bytes * 8.0::DOUBLE / block_elems AS bits_per_weight, "
    f"(list_product(dims)::BIGINT // block_elems * block_bytes)::BIGINT AS expected_bytes, (list_product(dims) / dims[-1])::BIGINT AS slice_elements, "
        f"CASE WHEN name LIKE '%ffn_gate_exps%' THEN 'gate' WHEN name LIKE '%ffn_up_exps%' THEN 'up' WHEN name LIKE '%ffn_down_exps%' THEN 'down' END "
            f"AS kind, ggml_type IN (0, 1, 2, 3, 8, 12, 14, 30) AS decodable, ((nbytes + 4095) // 4096 * 4096)::BIGINT AS aligned FROM t JOIN y USING (ggml_type)")
def tensor_shapes(spark, sf_dir):
    t = scalars.tensor_bytes(_tensors(spark))
    return t.select("name", "n_elements", "bits_per_weight", "expected_bytes", scalars.slice_elements(F.col("dims")).alias("slice_elements"),
        scalars.kind_of(F.col("name")).alias("kind"), scalars.can_decode(F.col("ggml_type")).alias("decodable"),
        scalars.align_up(F.col("nbytes"), 4096).alias("aligned"))


#: Published expert shapes as (repo, experts, hidden, inter).
REPOS = [("granite", 32, 1024, 512), ("olmoe", 64, 2048, 1024), ("qwen1.5", 60, 2048, 1408), ("qwen3-30b", 128, 2048, 768),
    ("dsv2-lite", 64, 2048, 1408), ("mixtral", 8, 4096, 14336), ("phi-3.5", 16, 4096, 6400), ("dense", None, 4096, 11008)]


@query("WITH c(repo, experts, hidden, inter) AS (VALUES " + ", ".join(f"('{r}', {e or 'NULL'}, {h}, {i})" for r, e, h,
    i in REPOS) + ") SELECT repo, hidden * inter * 4.5::DOUBLE / 8 AS slice_bytes, hidden * inter * 4.5::DOUBLE / 8 < 262144 AS in_band FROM c WHERE experts IS NOT NULL")
def survey_slices(spark, sf_dir):
    return model.survey(spark.createDataFrame(REPOS, "repo string, experts int, hidden long, inter long")).select("repo", "slice_bytes", "in_band")


@query("WITH c(repo, experts, hidden, inter) AS (VALUES " + ", ".join(f"('{r}', {e or 'NULL'}, {h}, {i})" for r, e, h,
    i in REPOS) + "), s AS (SELECT repo, hidden * inter * 4.5::DOUBLE / 8 AS b FROM c WHERE experts IS NOT NULL) SELECT count(*) FILTER (b < 262144) "
        "AS n_in_band, count(*) AS n, arg_min(repo, (b, repo)) AS smallest, min(b) AS smallest_bytes FROM s")
def survey_summary(spark, sf_dir):
    return model.survey_summary(model.survey(spark.createDataFrame(REPOS, "repo string, experts int, hidden long, inter long")))


@query(f"{_RANKED} SELECT 'blk.' || layer || '.ffn_up_exps.weight' AS tensor, slot AS slice, 'bytes differ' AS problem FROM h, range(0, 16) s(slot) WHERE r = 1 AND (slot * 7 + 3) % 16 = expert")
def verify_permutation(spark, sf_dir):
    """A checkpoint repacked by a permutation, in which a byte of each layer's hottest expert is then changed: verify finds these
    slices and no others."""
    from ..sources import container, open_file, plan, put_file, scratch, synth

    folder = scratch(spark, "verify")
    synth.checkpoint(f"{folder}/a", LAYERS, EXPERTS, 64, 64)
    names = [t.name for t in container.parse(f"{folder}/a").tensors]
    order = [(7 * slot + 3) % EXPERTS for slot in range(EXPERTS)]
    p = plan.Plan("a", "t", [plan.Layer(b, [n for n in names if n.startswith(f"blk.{b}.")], order) for b in range(LAYERS)])
    model.repack(f"{folder}/a", p, f"{folder}/b", 4096)
    f, size = open_file(f"{folder}/b")
    with f:
        data = bytearray(f.read(size))
    c = container.parse(f"{folder}/b")
    for r in predict.hottest(stats.hot_rank(_freq(spark, sf_dir)), 1).collect():  # a row per layer
        t = c.by_name[f"blk.{r['layer']}.ffn_up_exps.weight"]
        data[c.data_start + t.offset + t.nbytes // EXPERTS * order.index(r["expert"])] ^= 1
    put_file(f"{folder}/c", bytes(data))
    return model.verify(spark, f"{folder}/a", f"{folder}/c", p)


_REC = "rec AS (SELECT (vec_id // 48)::INT AS layer, ((vec_id // 3) % 16)::INT AS slot, ['gate', 'up', 'down'][vec_id % 3 + 1] AS kind, (64 + vec_id % 7)::BIGINT AS nbytes, vec_id % 3 AS k FROM embeddings)"


def _records(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 48").cast("int").alias("layer"),
        (F.expr("vec_id div 3") % 16).cast("int").alias("slot"),
        F.get(F.array(F.lit("gate"), F.lit("up"), F.lit("down")), (v % 3).cast("int")).alias("kind"), (64 + v % 7).cast("long").alias("nbytes"))


_PLACED = f"""{_REC}, g AS (SELECT layer, slot // 4 AS g, sum(nbytes) AS size FROM rec GROUP BY ALL),
s AS (SELECT *, coalesce(sum((size + 1023) // 1024 * 1024) OVER (ORDER BY layer, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g),
p AS (SELECT rec.*, (s.start + coalesce(sum(nbytes) OVER (PARTITION BY rec.layer, slot // 4 ORDER BY slot, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset, dense_rank() OVER (ORDER BY rec.layer, s.g) - 1 AS group_id FROM rec JOIN s ON s.layer = rec.layer AND s.g = slot // 4)"""


@query(f"WITH {_PLACED} SELECT layer, slot, kind, nbytes, \"offset\", group_id::INT AS group_id FROM p")
def store_layout(spark, sf_dir):
    from ..sources import store

    return store.layout(_records(spark, sf_dir), 1024, 4).drop("align")


@query(f"WITH {_PLACED} SELECT count(*) AS records, sum(nbytes)::BIGINT AS payload_bytes, max(\"offset\" + nbytes)::BIGINT AS data_bytes, "
    f"(max(\"offset\" + nbytes) - sum(nbytes))::BIGINT AS padding_bytes, count(DISTINCT group_id) AS groups, count(*) * 40 AS index_bytes FROM p")
def store_stats(spark, sf_dir):
    from ..sources import store

    return store.stats(store.layout(_records(spark, sf_dir), 1024, 4))


@query(f"WITH {_PLACED} SELECT layer, slot, sum(nbytes)::BIGINT AS bytes, min(\"offset\")::BIGINT AS \"offset\", (max(\"offset\" + nbytes) - "
    f"min(\"offset\"))::BIGINT AS span, max(\"offset\" + nbytes) - min(\"offset\") = sum(nbytes) AS contiguous FROM p GROUP BY ALL")
def store_spans(spark, sf_dir):
    from ..sources import store

    return store.spans(store.layout(_records(spark, sf_dir), 1024, 4))


# The report


def _layer(spark):
    return model.moe_layers(_tensors(spark)).where("block = 0").withColumn("n_layers", F.lit(LAYERS))


@query()
def advise_report(spark, sf_dir):
    wide, n = derive.trace_wide(spark, sf_dir), n_tokens(spark, sf_dir)
    layer = _layer(spark)
    entropy = stats.byte_entropy(table(spark, sf_dir, "documents").select(F.lit(0).alias("key"), F.col("text").cast("binary").alias("data")))
    found = advise.model_findings(layer, derive.surface(spark), entropy) + advise.trace_findings(wide, layer, LAYERS, EXPERTS, TOP_K, n, 64 << 10, 0.7, 100, derive.surface(spark))
    return advise.ranked(found)


@query(f"""WITH {TRACE_SQL}, f AS (SELECT expert, count(*) AS n FROM trace WHERE layer = 0 GROUP BY expert), h AS (SELECT *, row_number() OVER (ORDER BY n DESC, expert) AS r FROM f),
o AS (SELECT count(a.expert) / count(*)::DOUBLE AS o FROM trace b LEFT JOIN trace a ON a.token = b.token - 1 AND a.layer = b.layer AND a.expert = b.expert WHERE b.token > 0),
x AS (SELECT 6 AS idx, 'expert cache' AS topic, sum(n) FILTER (r <= 4) / sum(n)::DOUBLE AS metric, 0.25::DOUBLE AS baseline FROM h UNION ALL SELECT 10, 'prefetch', o, 0.25 FROM o UNION ALL SELECT 8, 'expert pruning', (16 - count(*))::DOUBLE, 16.0::DOUBLE FROM f)
SELECT idx, topic, round(metric, {R}) AS metric, baseline, CASE WHEN topic = 'expert pruning' THEN CASE WHEN metric / baseline > 0.05 THEN 'MARGINAL' ELSE 'SKIP' END WHEN metric / baseline >= 1.5 THEN 'DO' WHEN metric / baseline >= 1.15 THEN 'MARGINAL' ELSE 'SKIP' END AS verdict, round(metric / baseline, {R}) AS ratio FROM x""")
def advise_findings(spark, sf_dir):
    layer = _layer(spark)
    found = advise.trace_findings(derive.trace_wide(spark, sf_dir), layer, LAYERS, EXPERTS, TOP_K, n_tokens(spark, sf_dir), 4 * 15936, 0.7)
    rows = advise.ranked(found).where(F.col("idx").isin(6, 8, 10)).drop("rank")
    return rounded(rows, "metric", "ratio")


# Files and streams


@query(f"WITH {TRACE_SQL} SELECT * FROM trace")
def trace_file_round_trip(spark, sf_dir):
    """The trace written as one binary file and read again by ranges of tokens."""
    from ..sources import scratch
    from ..sources import trace as traces

    path = f"{scratch(spark, 'trace')}/t.bin"
    traces.write(derive.trace(spark, sf_dir), path, LAYERS, EXPERTS, TOP_K, 100)
    return traces.read(spark, path, 128)


@query("SELECT (vec_id // 48)::INT AS layer, ((vec_id // 3) % 16)::INT AS slot, ['gate', 'up', 'down'][vec_id % 3 + 1] AS kind, (CASE WHEN vec_id % 2 "
    "= 0 THEN 2 ELSE 4 END)::INT AS ty, 64::BIGINT AS n_weights, (CASE WHEN vec_id % 2 = 0 THEN 36 ELSE 20 END)::BIGINT AS nbytes FROM embeddings")
def store_file_round_trip(spark, sf_dir):
    """Embeddings quantised as expert slices, written as a store and read again, without payloads."""
    from ..sources import scratch, store

    vid = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 48").cast("int").alias("layer"),
        (F.expr("vec_id div 3") % 16).cast("int").alias("slot"),
        F.get(F.array(F.lit("gate"), F.lit("up"), F.lit("down")), (vid % 3).cast("int")).alias("kind"),
        F.when(vid % 2 == 0, "Q4").otherwise("Q2").alias("type"), F.col("embedding").alias("weights"))
    path = f"{scratch(spark, 'store')}/s.bin"
    store.write(store.quantise(rows), path, 4096, 4)
    return store.read(spark, path, payload=False).select("layer", "slot", "kind", "ty", "n_weights", "nbytes")


@query(f"SELECT {4 * LAYERS + 1} AS tensors, {4 * LAYERS} AS permuted, 0 AS mismatches")
def repack_round_trip(spark, sf_dir):
    """A checkpoint repacked by co-activation order and verified: (tensors, permuted, mismatches)."""
    from ..sources import plan, scratch, synth
    from ..sources import container

    folder = scratch(spark, "repack")
    synth.checkpoint(f"{folder}/a", LAYERS, EXPERTS, 64, 64)
    order = layout.seriation(stats.coactivation(derive.trace_wide(spark, sf_dir)), EXPERTS).orderBy("layer", "slot").collect()  # a row per expert
    names = [t.name for t in container.parse(f"{folder}/a").tensors]
    p = plan.Plan("a", "t", [plan.Layer(b, [n for n in names if n.startswith(f"blk.{b}.")], [r["expert"] for r in order if r["layer"] == b]) for b in range(LAYERS)])
    done = model.repack(f"{folder}/a", p, f"{folder}/b", 4096)
    bad = model.verify(spark, f"{folder}/a", f"{folder}/b", p)
    return bad.agg(F.count(F.lit(1)).alias("mismatches")).select(F.lit(done["tensors"]).alias("tensors"), F.lit(done["permuted"]).alias("permuted"), "mismatches")


@query(f"{_DIST} SELECT 'users' AS cache, count(*) FILTER (distance < 40) AS hits, count(*) FILTER (distance IS NULL OR distance >= 40) AS misses FROM p LEFT JOIN d USING (seq)")
def stream_lru(spark, sf_dir):
    """The access log as a stream through an LRU cache kept in the state store."""
    import uuid

    from ..sources import scratch
    from ..streaming import lru

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    accesses = events.select(F.lit("users").alias("cache"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("user_id").alias("key"))
    name = f"lru_{uuid.uuid4().hex}"
    # One cache needs one partition, and each has a state store. A query keeps the settings it starts with; the session gets its own back.
    wanted = {"spark.sql.shuffle.partitions": "2", "spark.sql.streaming.stateStore.providerClass": lru.PROVIDER}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        updates = lru.lru_stream(accesses, 40).writeStream.outputMode("update").format("memory").queryName(name)
        q = updates.option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    q.awaitTermination()
    return spark.table(name).groupBy("cache").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"))
