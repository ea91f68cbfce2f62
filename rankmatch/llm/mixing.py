"""Mixing sources to target weights by capped water-filling.

Targets solve ``target = min(cap, level * weight)`` with the targets' sum fixed: order the sources by ``cap / weight``; the
level is found where the first source fits below it. That is the end of clamping and resharing, without iterations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import col, durable, sized_broadcast, text_or_empty

WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """``cycle``: weights of the sources in code point order, repeating; ``epochs``: most times a source may be taken."""

    cycle: tuple[int, ...] = (5, 2, 1)
    epochs: int = 3
    seed: str = "mix-1"


def n_words(name: str) -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def place(key: Column, config: MixConfig) -> Column:
    """The document's place in the seeded order; equal ids share one."""
    return F.md5(F.concat(F.lit(config.seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per source of ``sizes`` (source, source_size): weight, target and the words of whole and partial repetitions.

    Sources without words have target 0; no sources give no rows. All windows run over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, config.cycle)), (F.row_number().over(by_name) - 1) % len(config.cycle) + 1)
    cap = F.col("source_size") * config.epochs
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    all_rows = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level.cast("double"))
    # the first source that stays under its cap sets the level for all after it
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("level").alias("level")))).over(all_rows)["level"]
    target = F.coalesce(F.least(F.col("cap").cast("double"), final * F.col("weight")), F.col("cap").cast("double"))
    out = leveled.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.select("source", "source_size", "weight", "target", whole.alias("whole"), (F.floor("target").cast("long") - whole * F.col("source_size")).alias("extra"))


def plan_mix(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``sizes`` (source, place, size) to one row per source: targets, and the place up to which documents are taken once more.

    The boundary is found in two steps, so that no source is ordered as a whole: sums of 65,536 ranges of places, then the
    documents of the one range in which the extra words end.
    """
    sums = durable(sizes.groupBy("source", F.substring("place", 1, 4).alias("range")).agg(F.sum("size").alias("words")))
    plan = durable(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), config))
    up_to = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(F.col("source").alias("s"), "range", "words").withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    cut = ranges.join(sized_broadcast(plan), F.col("s").eqNullSafe(F.col("source"))).where((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("words"))).select("s", "range", "before", "extra")
    inside = sizes.join(sized_broadcast(durable(cut)), F.col("s").eqNullSafe(F.col("source")) & (F.col("range") == F.substring("place", 1, 4)))
    docs = inside.groupBy("s", "before", "extra", "place").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    within = Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    edge = docs.where((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("words"))).select("s", F.col("place").alias("edge"), F.floor((F.col("extra") - F.col("before")) / F.col("n")).cast("long").alias("edge_words"))
    return durable(plan.join(edge, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "whole", "edge", "edge_words"))


def mix(df: DataFrame, sized: DataFrame, key: str = "doc_id", source: str = "source", config: MixConfig = MixConfig()) -> DataFrame:
    """``df``, which has its words in ``__size``, with source_size, target, ``__whole`` and ``__part``.

    A document is taken ``__whole`` times as a whole, and once more for its first ``__part`` words: all of them before
    its source's boundary, some at the boundary, none after it. ``sized``: (source, place, size) of the same rows.
    Null sources are one source, the last; null ids are ordered as one id; rows of one id share the boundary's words.
    """
    plan = plan_mix(sized, config)
    at = F.col("__place")
    part = F.when(F.col("__edge").isNull() | (at > F.col("__edge")), F.lit(0)).when(at < F.col("__edge"), F.col("__size")).otherwise(F.least("__edge_words", "__size"))
    named = plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("edge").alias("__edge"), F.col("edge_words").alias("__edge_words"))
    joined = df.withColumn("__place", place(col(key), config)).join(sized_broadcast(named), F.col("__source").eqNullSafe(col(source)), "left")
    return joined.withColumn("__part", part.cast("long")).drop("__place", "__edge", "__edge_words", "__source")


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Taken words per document; each source's sum is its target's whole part, but for words lost to repeated ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = durable(docs.select("doc_id", "source", n_words("text").alias("__size")))
    out = mix(sized, sized.select("source", place(F.col("doc_id"), MixConfig()).alias("place"), F.col("__size").alias("size")))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__whole") * F.col("__size") + F.col("__part")).alias("taken"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM s),
l AS (SELECT *, (total - full_before)::DOUBLE / weight_left::DOUBLE AS level FROM c),
f AS (SELECT *, least(cap::DOUBLE, coalesce(arg_min(level, cap / weight) FILTER (level * weight <= cap) OVER (), 1e300) * weight) AS target FROM l),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM f),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(0, floor(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
"""
