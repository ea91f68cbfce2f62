"""SimHash near-duplicates with pivot distance tables.

Two fingerprints within ``k`` of ``bits`` differ in at most ``k`` blocks, so of ``blocks`` blocks some ``blocks - k`` are
equal: every choice of them is a table keyed by their bits, and each link meets in one table at least. Within a key, pairs are
discarded by the largest difference of their distances to the pivots (the triangle inequality lets no link go), and the
survivors are verified on the fingerprints. Each group of a key returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import col, durable, parallelism, sized_broadcast, small_batches, text_or_empty


@dataclass(frozen=True)
class SimHashConfig:
    """``slice_rows``: a key with more fingerprints is compared slice by slice, every pair of slices on its own."""

    words: int = 3
    seed: int = 42
    distance: int = 3
    blocks: int = 6
    pivots: int = 8
    slice_rows: int = 4096


def simhash(text: str | None, config: SimHashConfig = SimHashConfig()) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), config.words
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= n:
        spans = [(0, len(joined))]
    else:
        spans = zip(np.concatenate(([0], ends[:-n] + 1)).tolist(), ends[n - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], config.seed) for a, b in spans], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    ones = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: str, config: SimHashConfig) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("bigint")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, config) for t in batch], dtype=np.uint64).view(np.int64))

    return of(text_or_empty(text))


def pivot_words(n: int) -> list[int]:
    """Reference fingerprints by rule: the first n outputs of splitmix64."""
    out, x, m = [], 0, (1 << 64) - 1
    for _ in range(n):
        x = x + 0x9E3779B97F4A7C15 & m
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        z = (z ^ z >> 27) * 0x94D049BB133111EB & m
        out.append(z ^ z >> 31)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: Column, config: SimHashConfig) -> Column:
    """The Hamming distances to the pivots, a byte each, as one long."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(pivot_words(config.pivots)):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))).cast("long"), 8 * k))
    return out


def table_keys(fp: Column, config: SimHashConfig) -> Column:
    """Every choice of blocks - distance blocks: a key of the table's number and the bits of those blocks."""
    cuts = [64 * i // config.blocks for i in range(config.blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    tables = [sum(c) for c in combinations(masks, config.blocks - config.distance)]
    return F.array(*(F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(tables)))


def forest(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Spanning forests of the links in each group of rows (g, fp, pivots) that come ordered by g."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        g = batch["g"].to_numpy()
        edge = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on
        if edge or held and held[-1]["g"].iloc[-1] != g[-1]:
            yield _forest(pd.concat([*held, batch.iloc[:edge]]), distance)
            held = []
        held.append(batch.iloc[edge:])
    if held:
        yield _forest(pd.concat(held), distance)


def _forest(rows: pd.DataFrame, distance: int, step: int = 1 << 20) -> pd.DataFrame:
    g, fp, table = rows["g"].to_numpy(), rows["fp"].to_numpy(), rows["pivots"].to_numpy().view(np.uint8).reshape(-1, 8)
    group = np.concatenate(([0], np.cumsum(g[1:] != g[:-1])))
    order = np.argsort(group * 128 + table[:, 0], kind="stable")
    group, fp, table = group[order], fp[order], table[order].astype(np.int8)
    at = group * 128 + table[:, 0]
    ends = np.searchsorted(at, at + distance, side="right")  # the first pivot's distances differ by so much at most
    counts = ends - np.arange(len(at)) - 1
    root = np.arange(len(at))
    start = 0
    total = np.cumsum(counts)
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + step, side="right")))
        n = counts[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        for k in range(1, 8):
            near = np.abs(table[i, k] - table[j, k]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance
        i, j = i[near], j[near]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        start = stop
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})


def links(prints: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(a, b): links enough to connect all of ``prints`` (distinct ``fp``) that links of at most ``distance`` bits connect."""
    n = parallelism(prints.sparkSession)
    keyed = prints.select("fp", pivot_table(F.col("fp"), config).alias("pivots"), F.explode(table_keys(F.col("fp"), config)).alias("key")).select("fp", "pivots", F.xxhash64("key.t", "key.bits").alias("g"))
    hot = durable(keyed.groupBy("g").count().where(F.col("count") > config.slice_rows).select("g", F.ceil(F.col("count") / config.slice_rows).cast("int").alias("slices")))
    sliced = keyed.join(sized_broadcast(hot), "g", "left").withColumn("s", F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("slices", F.lit(1))))
    units = sliced.withColumn("t", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)))
    g = F.when(F.col("slices").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least("s", "t"), F.greatest("s", "t")))
    rows = units.select(g.alias("g"), "fp", "pivots").repartition(n, "g").sortWithinPartitions("g")
    distance = config.distance
    return rows.mapInPandas(lambda batches: forest(batches, distance), "a bigint, b bigint")


def classes(prints: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(fp, class) for every row of ``prints`` (distinct ``fp``): equal classes are linked, over others or directly."""
    found = components(links(prints, config))
    return prints.select("fp").join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("class"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the least key of the rows that links reach.

    Null and empty texts have fingerprint 0 and are linked like others; null keys are never the least of others. Equal
    fingerprints are one row before the search, so that groups of copies of any size cost what one document does.
    """
    small_batches(df.sparkSession)
    docs = durable(df.select(col(key).alias("doc_id"), fingerprints(text, config).alias("fp")))
    distinct = durable(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    known = durable(distinct.join(classes(distinct, config), "fp"))
    least = known.groupBy("class").agg(F.min("least").alias("component_id"))
    named = known.join(least, "class").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
