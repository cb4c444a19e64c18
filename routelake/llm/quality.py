"""Quality rules with risk-controlled thresholds. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, read, words

#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
#: Rules as (name, numerator, denominator, cutoffs from loose to tight): a document is above a cutoff c when
#: 1000 * numerator > c * denominator. Rules are tightened one after another in this order, which is fixed beforehand.
RULES = (
    ("symbols", "n_symbols", "word_chars", (300, 200, 150, 100, 80, 60, 40, 20, 10)),
    ("long_words", "word_chars", "n_words", (20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000, 6500)),
    ("dup_lines", "n_dup_lines", "n_words", (200, 150, 100, 80, 60, 50, 40, 30, 20)),
    ("repeats", "n_repeat_words", "n_words", (180, 170, 160, 150, 140, 130, 120, 110, 100)),
)
#: Steps of the sequence: a rule's next cutoff comes into force at each. A document above no cutoff has the step after all.
STEPS = sum(len(cutoffs) for *_, cutoffs in RULES)
#: The most rows of thresholds that are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 20_000


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, step; with carry, a struct row
    of all columns of docs.

    step is the first step of the sequence at which the document is rejected.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    df = docs.select("doc_id", "lang", *keep, text.alias("_t"), words(F.col("text")).alias("_w"))
    keep = ["row"] if carry else []
    grams = F.when(
        F.size("_w") >= 5,
        F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select("doc_id", "lang", *keep, "_t", "_w", grams.alias("_g"))
    # Only texts with a window twice are sorted: (window, place) in order, places whose neighbour has the same window, words under them.
    pairs = F.array_sort(F.transform(F.col("_g"), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    places = lambda p: F.array_sort(F.transform(F.filter(p, lambda x, j: (x["g"] == F.get(p, j - 1)["g"]) | (x["g"] == F.get(p, j + 1)["g"])), lambda x: x["i"]))
    covered = lambda q: F.aggregate(q, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a,
        x: F.struct((a["n"] + F.least(F.lit(5), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    # A one-element transform binds an intermediate array once instead of copying its expression.
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    repeated = F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(bind(pairs, lambda p: covered(places(p))))
    df = df.select(
        "doc_id",
        "lang",
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    firsts, at = [], 1
    for _, num, den, cutoffs in RULES:
        passed = sum(((1000 * F.col(num) <= c * F.col(den)).cast("int") for c in cutoffs), F.lit(0))
        firsts.append(F.when(passed < len(cutoffs), at + passed))
        at += len(cutoffs)
    return df.withColumn("step", F.coalesce(F.least(*firsts), F.lit(at)))


def stratum(lang: Column) -> Column:
    return F.concat(F.when(lang.isNull(), "1").otherwise("0"), F.coalesce(lang, F.lit("")))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, term by term in logarithms; 1 where k > p n, for which no test can pass."""
    import math

    odds, rest = math.log(p / (1 - p)), math.log1p(-p)
    start = F.struct((n * F.lit(rest)).alias("t"), F.exp(n * F.lit(rest)).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, step, lambda a: a["s"]))


def thresholds(feats: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Stratum, last_step: how far along the sequence of ever tighter rules a stratum may go.

    The holdout is every labelled document that the base rules keep; good ones have quality 1 and toxic 0. At a step that
    falsely rejects k of a stratum's n good ones, the exact binomial test of a risk above alpha has the level
    P(Bin(n, alpha) <= k). Steps are tested in their fixed order at delta / strata until the first that fails: such a
    sequence needs no correction for its length, strata are corrected by Bonferroni. So with probability 1 - delta no
    stratum's rules reject more than alpha of its good documents. Rejections grow from step to step, and so does the
    level: the last step below the limit is the one before the first above it.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.min(F.coalesce("quality", F.lit(0))) == 1).alias("q"),
        (F.max(F.coalesce("toxic", F.lit(0))) == 0).alias("c")).where("q AND c").select("_id")
    held = feats.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_id"), "left_semi")
    at_step = [F.sum((F.col("step") <= j).cast("long")).alias(f"k_{j}") for j in range(1, STEPS + 1)]
    counts = held.groupBy(stratum(F.col("lang")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *at_step)
    cells = F.explode(F.array(*[F.struct(F.lit(j).alias("step"), F.col(f"k_{j}").alias("k")) for j in range(1, STEPS + 1)]))
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    tested = counts.select("stratum", "n", cells.alias("c")).select("stratum", "n", "c.*").join(F.broadcast(strata))  # one row
    sure = tested.where(binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta) / F.col("strata"))
    return sure.groupBy("stratum").agg(F.max("step").alias("last_step"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05, carry: bool = False) -> DataFrame:
    """Features of every document, base_failed, and kept (false if base_failed or rejected by the certified rules of its stratum).

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. Null text: no words, so base_failed. Null lang: a stratum of
    its own. Several labels of a document: good only if all say so. Strata in which no step can be certified, as those
    with fewer than log(delta / strata) / log(1 - alpha) good labelled documents, and no labels at all: only the base rules
    reject. Repeated rows are judged alike. Extra columns are ignored; with carry they come back in a struct row.
    The written features are read twice; the documents are read once.
    """
    feats = materialize(features(docs, carry), "quality-features")
    cuts = materialize(thresholds(feats, labels, alpha, delta), "quality-cuts")
    bounded = cuts.count() <= BROADCAST_ROWS
    df = feats.withColumn("stratum", stratum(F.col("lang"))).join(F.broadcast(cuts) if bounded else cuts, "stratum", "left")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("step") > F.coalesce("last_step", F.lit(0))))


def kept_rows(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that judge keeps. Rows are written with their features and not looked up again."""
    return judge(docs, labels, carry=True, **how).where("kept").select("row.*")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(*COLUMNS)


def _oracle() -> str:
    firsts, at = [], 1
    for _, num, den, cutoffs in RULES:
        passed = " + ".join(f"(1000 * {num} <= {c} * {den})::INT" for c in cutoffs)
        firsts.append(f"CASE WHEN {passed} < {len(cutoffs)} THEN {at} + {passed} END")
        at += len(cutoffs)
    step = f"coalesce(least({', '.join(firsts)}), {at})"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT rid, i, w[i:i+4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, unnest(list(i)) AS i FROM grams GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + o.k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY rid),
f AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (CASE WHEN lang IS NULL THEN '1' ELSE '0' END) || coalesce(lang, '') AS stratum, {step} AS step FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(coalesce(toxic, 0)) = 0),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
cells AS (
  SELECT stratum, j, count(*) AS n, count(*) FILTER (step <= j) AS k FROM held, range(1, {STEPS + 1}) AS s(j) GROUP BY stratum, j),
tested AS (
  SELECT *, CASE WHEN k > n * 0.04::DOUBLE THEN 1 ELSE
    (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.04::DOUBLE) + (n - i) * ln(1 - 0.04::DOUBLE))) FROM range(0, k + 1) AS r(i)) END AS tail
  FROM cells),
cuts AS (SELECT stratum, max(j) AS last_step FROM tested WHERE tail <= 0.05::DOUBLE / (SELECT count(DISTINCT stratum) FROM held) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND step > coalesce(last_step, 0) AS kept
FROM b LEFT JOIN cuts USING (stratum)
"""


ORACLE = _oracle()
