"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, read, words

#: Hex digits of the seeded hash by which a source is narrowed down to its cut: sums per first digits, then per next ones.
DIGITS = 3
#: The most sources whose cuts are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000


def water_fill(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """(source, weight, source_size) -> the same and target.

    Targets share `share` times all sizes by weight and stop at max_epochs times the source's size. Clamping and
    resharing until none is above ends at one water level: with sources by size over weight ascending, those clamped
    are a prefix, so the level after each prefix decides it without a loop. The table has a row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(max_epochs)
    df = (
        sources.withColumn("ratio", cap / F.col("weight"))
        .withColumn("cap_before", F.coalesce(F.sum(cap).over(order), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    )
    # A source is clamped while its ratio is not above the level that the ones before it leave; the first that isn't sets the level.
    df = df.withColumn("open_level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "skey", "level"))).over(everything)["level"])
    target = F.when(F.col("open_level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("weight") * F.col("open_level")))
    return df.withColumn("target", target)


def source_key(source: Column) -> Column:
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def seeded_hash(seed: str, doc_id: Column, text: Column) -> Column:
    """Hex digits that put documents in order. Rows with equal ones are equal in doc_id and text."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))).cast("binary"))


def _hinted(per_source: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(per_source) if n_sources <= BROADCAST_ROWS else per_source


def cuts(sized: DataFrame, needs: DataFrame, n_sources: int) -> DataFrame:
    """skey, cut_h, cut_rid, cut_words: of a source's rows, those that stand before (cut_h, cut_rid) are in the part of
    `need` words, and the row there with its first cut_words words. Sources without a row are in it whole.

    sized: (skey, h, rid, size), written; needs: (skey, need). The place is narrowed down by sums per first digits of the
    hash, per next digits, per hash, then, among equal documents, per part of the written table, and at last among the
    rows of one part. Windows run over sums only, so neither a large source nor many equal documents meet in one task.
    """
    keys = {
        "d1": F.substring("h", 1, DIGITS),
        "d2": F.substring("h", DIGITS + 1, DIGITS),
        "cut_h": F.col("h"),
        "part": F.shiftright("rid", 33),
        "cut_rid": F.col("rid"),
    }
    found, known = needs, ["skey"]
    for name, key in keys.items():
        rows = sized.where("size > 0").select("skey", *[keys[k].alias(k) for k in known[1:]], key.alias(name), "size")
        if len(known) > 1:
            rows = rows.join(_hinted(found.select(*known), n_sources), known)
        sums = rows.groupBy(*known, name).agg(F.sum("size").alias("total")).join(_hinted(found, n_sources), known)
        before = F.sum("total").over(Window.partitionBy("skey").orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
        left = sums.withColumn("need", F.col("need") - F.coalesce(before, F.lit(0)))
        found = materialize(left.where("need >= 0 AND need < total").drop("total"), "mix-cut")
        known.append(name)
    return found.select("skey", "cut_h", "cut_rid", F.col("need").alias("cut_words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1", carry: bool = False) -> DataFrame:
    """Words that a mix takes of every document.

    docs: doc_id, text, source; other columns are ignored; with carry, all columns come back in a struct row. Result:
    doc_id, size (words), source_size, target (words the source should give), taken (words the mix takes of the document,
    repeats counted).
    Sources by code point, null last (an empty name is a name of its own), weigh `weights`, repeating. Every document is
    taken whole as often as target holds its source's size; of the rest, documents are taken whole in order of a
    seeded hash of doc_id and text up to the cut, and the document at the cut in part. So taken sums to target, rounded,
    exactly. Null or blank text: size 0, nothing taken. Null doc_id and repeated rows: documents of their own; of rows
    equal in doc_id and text any may stand at the cut. No rows: no rows.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sized = docs.select(
        *carried,
        F.col("doc_id"),
        n_words(F.col("text")).alias("size"),
        source_key(F.col("source")).alias("skey"),
        seeded_hash(seed, F.col("doc_id"), F.col("text")).alias("h"),
        F.monotonically_increasing_id().alias("rid"),  # written, and read from there alone
    )
    sized = materialize(sized, "mix-sizes")
    per_source = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy("skey")
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), rank + 1))
    plan = water_fill(weighted, share, max_epochs).select(
        "skey",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("reps"),
    ).withColumn("need", F.floor(F.col("target") + 0.5) - F.col("reps") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    n_sources = plan.count()
    plan = plan.join(cuts(sized, plan.select("skey", "need"), n_sources), "skey", "left")
    earlier = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("rid") < F.col("cut_rid")))
    at_cut = (F.col("h") == F.col("cut_h")) & (F.col("rid") == F.col("cut_rid"))
    part = F.when(F.col("cut_h").isNull() | earlier, F.col("size")).when(at_cut, F.col("cut_words")).otherwise(0)
    taken = (F.col("reps") * F.col("size") + part).alias("taken")
    return sized.join(_hinted(plan, n_sources), "skey").select("doc_id", "size", "source_size", "target", taken, *(["row"] if carry else []))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them; the one at a source's cut is also there with its first words alone.

    All columns stay; n_chars, if there, follows the text. Rows are written with their sizes and not looked up again.
    """
    taken = mix(docs, carry=True, **how).where("taken > 0").select("row", "size", "taken")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))
    df = taken.select("row", rest.alias("rest"), whole.alias("whole"), F.explode(copies).alias("copy"))
    cut = F.col("copy") > F.col("whole")
    text = F.when(cut, F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("rest")), " ")).otherwise(F.col("row.text"))
    df = df.select("row", cut.alias("cut"), text.alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("cut"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (CASE WHEN source IS NULL THEN '1' ELSE '0' END) || coalesce(source, '') AS skey,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS h
  FROM documents),
per_source AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per_source),
levels AS (
  SELECT *, (source_size * 2) / weight::DOUBLE AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM weighted WINDOW o AS (ORDER BY (source_size * 2) / weight::DOUBLE, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT min_by(level, (ratio, skey)) FILTER (ratio > level) AS open_level FROM levels),
plan AS (
  SELECT skey, source_size, CASE WHEN open_level IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, weight * open_level) END AS target
  FROM levels, opened),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS reps FROM plan),
walked AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.reps,
    floor(c.target + 0.5)::BIGINT - c.reps * c.source_size AS need,
    coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN cut c USING (skey))
SELECT doc_id, size, source_size, target, (reps * size + greatest(0, least(size, need - before)))::BIGINT AS taken FROM walked
"""
