"""Searches on streams: stateless filters and scores, for any streaming source and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.options import Mode, Preset, SearchOptions
from ..operators.search import match_score


def stream_search(stream: DataFrame, text: Column, query: str, mode: Mode = Mode.FUZZY, options: SearchOptions = SearchOptions(), preset: Preset = Preset()) -> DataFrame:
    """Rows that match, with their ``score``. Order and limit need the whole result: apply them in foreachBatch or after."""
    return stream.withColumn("score", match_score(F.coalesce(text.cast("string"), F.lit("")), query, mode, options, preset)).where("score >= 0")
