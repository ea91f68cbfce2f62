"""Many queries in one scan of the corpus, with the best hits of each."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel
from ..functions.options import Mode, Preset, Scoring, SearchOptions
from ..functions.predicates import matches
from ..functions.query import parse
from .search import best_of, is_native

HITS = "array<struct<q:int,score:int,key:int>>"


def search_many(items: DataFrame, queries: list[str], mode: Mode, options: SearchOptions, preset: Preset, keyed: bool = False) -> DataFrame:
    """(query, idx, score, matched_kind, matched_key, rank); ``queries`` is a list on the driver and sent to all tasks.

    A native filter lets through what some query matches. Queries without fuzzy words are scored natively; for the others each
    batch of texts is decoded and classified once. Ranks are cut before the shuffle as well.
    """
    scoring, plans = options.scoring, [parse(q, Mode(mode), options.case, options.norm, preset.unicode) for q in queries]
    native = [q for q, atoms in enumerate(plans) if is_native(atoms, scoring)]
    fuzzy = [q for q in range(len(plans)) if q not in native]
    texts = F.concat(F.array("text"), F.transform("keys", lambda k: k["text"])) if keyed else F.array("text")

    @F.pandas_udf("struct<q:array<int>,score:array<int>,key:array<int>>")
    def every(batch: pd.Series) -> pd.DataFrame:
        counts = np.fromiter(map(len, batch), dtype=np.int64, count=len(batch))
        shared, first = kernel.Batch([t for row in batch for t in row], preset), np.cumsum(counts) - counts
        rows, found = np.repeat(np.arange(len(batch)), counts), []
        for q in fuzzy:
            total, alive = np.zeros(shared.n, dtype=np.int64), np.ones(shared.n, dtype=bool)
            for a in plans[q]:
                s = kernel.scores(shared, a, Scoring.OFF if a.negative else scoring)
                alive &= (s < 0) if a.negative else (s >= 0)
                total += 0 if a.negative else s
            total = np.where(alive, total, -1)
            best = np.maximum.reduceat(total, first)
            at = np.flatnonzero((total == best[rows]) & alive)
            row, where = np.unique(rows[at], return_index=True)
            found.append((row, np.full(len(row), q), best[row], at[where] - first[row]))
        row, *values = map(np.concatenate, zip(*found))
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(1, len(batch)))
        return pd.DataFrame({name: pd.Series(np.split(v[order].astype(np.int32), cuts), dtype=object) for name, v in zip(("q", "score", "key"), values)})

    some = F.exists(texts, lambda t: reduce(lambda a, b: a | b, [matches(t, atoms, preset.unicode) for atoms in plans], F.lit(False)))
    found, hits = items.where(some), []
    if native:
        each = F.array(*(F.struct(F.lit(q).alias("q"), best_of(texts, plans[q], scoring, preset).alias("b")) for q in native))
        hits.append(F.transform(F.filter(each, lambda h: h["b"]["score"] >= 0), lambda h: F.struct(h["q"].alias("q"), h["b"]["score"].alias("score"), h["b"]["key"].alias("key"))).cast(HITS))
    if fuzzy:
        found = found.withColumn("__found", every(texts))
        hits.append(F.arrays_zip(*(F.col(f"__found.{n}").alias(n) for n in ("q", "score", "key"))).cast(HITS))
    hit = F.explode(F.concat(*hits) if hits else F.expr(f"cast(array() as {HITS})")).alias("hit")
    flat = found.select("idx", *(["keys"] if keyed else []), hit)
    kind = F.when(F.col("hit.key") == 0, F.lit(0)).otherwise(F.get(F.col("keys"), F.col("hit.key") - 1)["kind"]) if keyed else F.lit(0)
    flat = flat.select(F.col("hit.q").alias("q"), "idx", F.col("hit.score").alias("score"), kind.cast("int").alias("matched_kind"), F.col("hit.key").alias("matched_key"))
    order = [F.col("idx")] if scoring == Scoring.OFF else [F.col("score").desc(), F.col("idx")]
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
    if options.limit:
        ranked = ranked.where(F.col("rank") <= options.limit)
    return ranked.select(F.element_at(F.array(*map(F.lit, queries)), F.col("q") + 1).alias("query"), "idx", "score", "matched_kind", "matched_key", "rank")
