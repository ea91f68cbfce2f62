"""The search plan: native filter, score, best key per item, order and limit, positions of the hits that remain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernel
from ..functions.literal import is_literal, literal_scores
from ..functions.options import Mode, Preset, Scoring, SearchOptions
from ..functions.predicates import matches
from ..functions.query import Atom, parse

HIT = ("idx", "score", "matched_kind", "matched_key", "indices")


def match_score(text: Column, query: str, mode: Mode = Mode.FUZZY, options: SearchOptions = SearchOptions(), preset: Preset = Preset()) -> Column:
    """The score of one text, -1 without a match; usable in any DataFrame, joins and streams included."""
    atoms = parse(query, Mode(mode), options.case, options.norm, preset.unicode)
    return text_score(F.coalesce(text, F.lit("")), atoms, options.scoring, preset)


def is_native(atoms: tuple[Atom, ...], scoring: Scoring) -> bool:
    return scoring == Scoring.OFF or all(a.negative or is_literal(a) for a in atoms)


def text_score(text: Column, atoms: tuple[Atom, ...], scoring: Scoring, preset: Preset) -> Column:
    """The score or -1. Python is asked for words in fuzzy mode only."""
    if is_native(atoms, scoring):
        score = F.lit(0) if scoring == Scoring.OFF else literal_scores(text, atoms, preset)
        return F.when(matches(text, atoms, preset.unicode), score).otherwise(F.lit(-1))

    @F.pandas_udf("int")
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(kernel.score_texts(batch.tolist(), atoms, scoring, preset)).astype("int32")

    return score.asNondeterministic()(text)  # else a filter on the score evaluates it twice


def best_of(texts: Column, atoms: tuple[Atom, ...], scoring: Scoring, preset: Preset) -> Column:
    """``struct<score,key>`` of the first best text of an array, natively."""
    each = F.transform(texts, lambda t: text_score(t, atoms, scoring, preset))
    return F.get(F.transform(F.array(each), lambda s: F.struct(F.array_max(s).alias("score"), (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("key"))), F.lit(0))


def match_indices(text: Column, query: str, mode: Mode = Mode.FUZZY, options: SearchOptions = SearchOptions(), preset: Preset = Preset()) -> Column:
    """Matched code point positions of a text that matches."""
    atoms = parse(query, Mode(mode), options.case, options.norm, preset.unicode)
    scoring = options.scoring

    @F.pandas_udf("array<int>")
    def at(batch: pd.Series) -> pd.Series:
        return pd.Series([kernel.positions(t or "", atoms, scoring, preset) if _alive(t or "", atoms, preset) else [] for t in batch])

    return at(text)


def _alive(text: str, atoms: tuple[Atom, ...], preset: Preset) -> bool:
    return kernel.score_texts([text], atoms, Scoring.OFF, preset)[0] >= 0


def scored(items: DataFrame, atoms: tuple[Atom, ...], scoring: Scoring, preset: Preset, keyed: bool) -> DataFrame:
    """Matching items with ``score`` and ``matched_key``. The first key with the largest score wins."""
    own = matches(F.col("text"), atoms, preset.unicode)
    if not keyed:
        found = items.where(own).withColumn("score", text_score(F.col("text"), atoms, scoring, preset))
        return (found if is_native(atoms, scoring) else found.where("score >= 0")).withColumn("matched_key", F.lit(0))
    texts = F.transform("keys", lambda k: k["text"])
    found = items.where(own | F.exists(texts, lambda t: matches(t, atoms, preset.unicode)))
    if is_native(atoms, scoring):
        best = best_of(F.concat(F.array("text"), texts), atoms, scoring, preset)
        return found.withColumn("__best", best).withColumn("score", F.col("__best.score")).withColumn("matched_key", F.col("__best.key")).drop("__best")

    @F.pandas_udf("struct<score:int,key:int>")
    def best(text: pd.Series, more: pd.Series) -> pd.DataFrame:
        counts = [1 + len(m) for m in more]
        flat = [t for own_text, m in zip(text, more) for t in (own_text, *m)]
        s = kernel.score_texts(flat, atoms, scoring, preset)
        rows, at = [], 0
        for n in counts:
            part = s[at : at + n]
            k = int(part.argmax())
            rows.append((int(part[k]), k))
            at += n
        return pd.DataFrame(rows, columns=["score", "key"], dtype="int32")

    out = found.withColumn("__best", best.asNondeterministic()("text", texts)).where("__best.score >= 0")
    return out.withColumn("score", F.col("__best.score")).withColumn("matched_key", F.col("__best.key")).drop("__best")


def with_indices(hits: DataFrame, atoms: tuple[Atom, ...], scoring: Scoring, preset: Preset, limited: bool) -> DataFrame:
    """Positions in the winning key. After a limit ``mapInPandas`` keeps the plan's TakeOrderedAndProject."""
    if not limited:

        @F.pandas_udf("array<int>")
        def at(batch: pd.Series) -> pd.Series:
            return pd.Series([kernel.positions(t, atoms, scoring, preset) for t in batch])

        return hits.withColumn("indices", at("__won"))
    schema = T.StructType([*hits.schema.fields, T.StructField("indices", T.ArrayType(T.IntegerType()))])

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(indices=[kernel.positions(t, atoms, scoring, preset) for t in batch["__won"]])

    return hits.mapInPandas(project, schema)


def search(items: DataFrame, query: str, mode: Mode, options: SearchOptions, preset: Preset, keyed: bool) -> DataFrame:
    """``items`` (idx, text, keys if keyed, raw) to hits in order: score descending, then idx; without scores idx alone."""
    mode = Mode(mode)
    atoms = parse(query, mode, options.case, options.norm, preset.unicode)
    if options.parallel and options.threads > items.sparkSession.sparkContext.defaultParallelism:
        items = items.repartition(options.threads)
    hits = scored(items, atoms, options.scoring, preset, keyed)
    kind, won = F.lit(0), F.col("text")
    if keyed:
        extra = F.get(F.col("keys"), F.col("matched_key") - 1)
        kind = F.when(F.col("matched_key") == 0, F.lit(0)).otherwise(extra["kind"])
        won = F.when(F.col("matched_key") == 0, F.col("text")).otherwise(extra["text"])
    columns = [F.col("idx"), F.col("score").cast("int").alias("score"), kind.cast("int").alias("matched_kind"), F.col("matched_key").cast("int").alias("matched_key")]
    hits = hits.select(*columns, *([won.alias("__won")] if options.highlight else []), "raw")
    if not options.limit and not is_native(atoms, options.scoring):
        hits = hits.repartition("idx")  # a sort reads its input twice, first for its ranges: Python scores each text once
    order = [F.col("idx")] if options.scoring == Scoring.OFF else [F.col("score").desc(), F.col("idx")]
    hits = hits.orderBy(*order)
    if options.limit:
        hits = hits.limit(options.limit)
    if options.highlight:
        hits = with_indices(hits, atoms, options.scoring, preset, bool(options.limit))
    else:
        hits = hits.withColumn("indices", F.expr("cast(array() as array<int>)"))
    return hits.select(*HIT, "raw")
