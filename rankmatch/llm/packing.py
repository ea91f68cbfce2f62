"""Best-fit packing planned on the histogram of lengths.

The planner never sees documents: it fits counts of equal lengths into counts of equally filled sequences, longest first,
always into the least room that suffices. Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import col, durable, sized_broadcast, small_batches, text_or_empty


@dataclass(frozen=True)
class PackConfig:
    """``vocabulary``: a byte-level BPE file of the tokenizers library; ``rank_rows``: rows that one task ranks."""

    vocabulary: str | None = None
    capacity: int = 1024
    end_id: int = 2
    rank_rows: int = 50_000

    def path(self) -> str:
        if self.vocabulary:
            return self.vocabulary
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict = {}


def encoder(path: str):
    """An encoder with the file's vocabulary whose ids equal the tokenizers library's, several times as fast.

    The file's ids are in order of merging, so that they serve as ranks. Added tokens split a text and are one id each.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]["vocab"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in token): i for token, i in model.items() if all(c in shown for c in token)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for token in special:
            ranks.pop(token.encode(), None)
        _encoders[path] = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that has the rest."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", config: PackConfig = PackConfig(), with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document as its token ids and the end id, cut to capacity."""
    path, capacity, end = config.path(), config.capacity, config.end_id
    kind = dict(df.dtypes)[key]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            ids, rows = [], []
            for k, t in zip(batch["doc_id"], batch["text"]):
                own = np.array([*enc.encode(t, allowed_special="all"), end], dtype="<u4")
                for i, (start, n) in enumerate(cut(len(own), capacity)):
                    part = own[start : start + n]
                    rows.append((k, i, start, n, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids.append(part.astype(np.int64))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            if with_ids:
                out["ids"] = ids
            yield out

    schema = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    small_batches(df.sparkSession)
    rows = df.select(col(key).cast("string").alias("doc_id"), text_or_empty(text).alias("text"))  # pandas would round long ids beside a null
    return rows.mapInPandas(encode, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


@dataclass
class _Open:
    """``count`` sequences from number ``first`` on, each filled up to ``used``."""

    first: int
    count: int
    used: int


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, first_sequence, offset, per_sequence) for all ranks of all lengths.

    Slots of an interval go to consecutive sequences, ``per_sequence`` to each, from ``offset`` on. Both the open groups and
    the intervals are bounded by the capacity, whatever the counts: a length opens at most two groups and splits one.
    """
    rooms: list[list[_Open]] = [[] for _ in range(capacity + 1)]
    made, out = 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            if room is None:
                group, room = _Open(made, -(-left // (capacity // length)), 0), capacity
                made += group.count
            else:
                group = rooms[room].pop()
            each = room // length
            full = min(group.count, left // each)
            for count, per in ((full, each), (min(1, group.count - full), min(left - full * each, each))):
                if count and per:
                    out.append((length, rank, rank + count * per, group.first, group.used, per))
                    rooms[room - per * length].append(_Open(group.first, count, group.used + per * length))
                    rank, left = rank + count * per, left - count * per
                    group = _Open(group.first + count, group.count - count, group.used)
            if group.count:
                rooms[room].append(group)
    return out


def ranked(cut_up: DataFrame, histogram: dict[int, int], config: PackConfig) -> DataFrame:
    """``rank`` from 0 within each length. Common lengths are ranked in parts by hash, offset by the parts' counts."""
    spark = cut_up.sparkSession
    parts = F.broadcast(spark.createDataFrame([(n, 1 + c // config.rank_rows) for n, c in sorted(histogram.items())] or [(0, 1)], "length long, parts long"))  # at most ``capacity`` rows
    salted = cut_up.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(salted.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    return salted.withColumn("rank", own - 1).join(sized_broadcast(offsets), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")


def pack(cut_up: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """``cut_up`` (durable, with doc_id, piece, length, ids_crc32) with its ``sequence_id`` and ``offset``.

    No rows give no rows; repeated rows take slots of their own. The histogram is the only thing collected: its rows are
    the lengths from 1 to the capacity.
    """
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = np.array(sorted(plan_slots(histogram, config.capacity)) or [(0,) * 6], dtype=np.int64)
    starts = slots[:, 0] << 48 | slots[:, 1]

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = slots[np.searchsorted(starts, n << 48 | r, side="right") - 1]
        own = r - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 3] + own // s[:, 5], "offset": s[:, 4] + own % s[:, 5] * n})

    placed = ranked(cut_up, histogram, config).withColumn("__slot", place("length", "rank"))
    return placed.withColumn("sequence_id", F.col("__slot.sequence_id")).withColumn("offset", F.col("__slot.offset")).drop("__slot", "rank")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """One row per piece. Null and empty texts are the end id alone."""
    cut_up = durable(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return pack(cut_up).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
