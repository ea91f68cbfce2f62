"""Document fingerprints by improved consistent weighted sampling.

For a term of weight w and sample k with r, c ~ Gamma(2, 1) and beta ~ U(0, 1), drawn from the term alone:
``t = floor(ln w / r + beta)``, ``ln a = ln c - r (t - beta) - r``; the sample is the (term, t) of the least a. Two documents share a
sample with the probability of their generalised Jaccard similarity, sum of min weights over sum of max weights.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import col, durable, parallelism, sized_broadcast, text_or_empty


@dataclass(frozen=True)
class CwsConfig:
    """Terms are lower-cased words, weighted by their counts. ``samples``: the likeness has a standard error of
    sqrt(J (1 - J) / samples). ``block``: terms drawn at once, which bounds the memory for texts of any length."""

    samples: int = 96
    seed: int = 5
    block: int = 4096


@functools.cache
def _gamma() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 65,536 equal parts, by Newton's method on 1 - (1 + x) exp(-x)."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.where(u < 0.26, np.sqrt(2 * u), 1 - np.log1p(-u) + np.log1p(-np.log1p(-u)))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 2)
    return x.astype(np.float32)


@functools.cache
def _log_gamma() -> np.ndarray:
    return np.log(_gamma())


@functools.cache
def _keys(config: CwsConfig) -> np.ndarray:
    return np.random.default_rng(config.seed).integers(0, 1 << 63, config.samples, dtype=np.uint64)[:, None]


def draws(terms: np.ndarray, config: CwsConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and 1 - beta of every (sample, term) from one mixed 64-bit word: 16, 16 and 32 bits."""
    x = terms[None, :] ^ _keys(config)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    parts = x.view("<u2").reshape(*x.shape, 4)
    rest = x.view("<u4").reshape(*x.shape, 2)[:, :, 0].astype(np.float32)
    rest *= np.float32(2.0**-32)
    return _gamma().take(parts[:, :, 3]), _log_gamma().take(parts[:, :, 2]), rest


def signatures(terms: np.ndarray, weights: list[np.ndarray], config: CwsConfig) -> np.ndarray:
    """One signature per array of weights over the same distinct terms (0: absent); all draws are made once."""
    best = np.full((len(weights), config.samples), np.inf, dtype=np.float32)
    sign = np.zeros((len(weights), config.samples), dtype=np.uint64)
    rows = np.arange(config.samples)
    for start in range(0, len(terms), config.block):
        own = terms[start : start + config.block]
        r, lnc, rest = draws(own, config)
        single = lnc - r * rest  # t is 0 for weight 1
        for k, all_weights in enumerate(weights):
            w = all_weights[start : start + config.block]
            there = np.flatnonzero(w)
            if not len(there):
                continue
            lo, hi = there[0], there[-1] + 1
            lna = single[:, lo:hi].copy()
            if len(there) < hi - lo:
                lna[:, w[lo:hi] == 0] = np.inf
            many = np.flatnonzero(w > 1)
            t = np.zeros((config.samples, 0), dtype=np.float32)
            if len(many):
                rm, beta = r[:, many], 1 - rest[:, many]
                t = np.floor(np.log(w[many]).astype(np.float32) / rm + beta)
                lna[:, many - lo] = lnc[:, many] - rm * (t - beta) - rm
            at = lna.argmin(axis=1)
            low = lna[rows, at]
            won = low < best[k]
            best[k][won] = low[won]
            at += lo
            column = np.full(len(own), -1)
            column[many] = np.arange(len(many))
            of_many = column[at]
            level = np.where(of_many >= 0, t[rows, of_many], 0) if len(many) else np.zeros(config.samples)
            value = own[at] ^ level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            sign[k][won] = value[won]
    return (sign * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def terms_of(text: str) -> Counter:
    return Counter(text.encode("utf-8", "surrogatepass").lower().split())


def sketch(texts: tuple[str, ...], config: CwsConfig = CwsConfig()) -> np.ndarray:
    """Signatures of one or two texts, such as a document and its edited text, whose common terms are drawn once. Without terms: all zeros."""
    import xxhash

    bags = [terms_of(t) for t in texts]
    first, last = bags[0], bags[-1]
    every = [w for w in first if w not in last] + [w for w in first if w in last]  # the terms of a bag lie together
    every += [w for w in last if w not in first]
    weights = [np.fromiter(map(b.get, every, repeat(0)), dtype=np.int64, count=len(every)) for b in bags]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, every, repeat(config.seed)), dtype=np.uint64, count=len(every))
    return signatures(hashes, weights, config)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def to_hex(signature: np.ndarray) -> str:
    return signature.astype("<u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def with_next(df: DataFrame, key: str, text: str, body, schema: str) -> DataFrame:
    """``body`` over documents in ascending order of key: it gets an iterator of (key, text, next text).

    Rows are dealt into ranges of keys; the least key's rows of each range are sent to the range before it as well, so that
    each range knows what follows its last row. Texts are shuffled once; rows of equal keys follow by text; null keys
    come first; the last row is followed by the first.
    """
    parts = 2 * parallelism(df.sparkSession)
    if dict(df.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {dict(df.dtypes)[key]}; the order of documents needs an integer key")
    docs = df.select(col(key).cast("bigint").alias("k"), text_or_empty(text).alias("t"))
    cuts = docs.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]  # one number a range
    cuts = np.unique(np.array(cuts if cuts is not None else [], dtype=np.int64))

    @F.pandas_udf("int")
    def place(k: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series(np.where(null, -1, np.searchsorted(cuts, k.to_numpy(np.int64), side="left") * 2)).astype("int32")

    bucket = place(F.coalesce("k", F.lit(0)), F.col("k").isNull())  # pandas would round long keys beside a null
    dealt = docs.withColumn("b", bucket)
    heads = {r["b"]: r["k"] for r in docs.select("k").withColumn("b", bucket).groupBy("b").agg(F.min("k").alias("k")).collect()}  # a row a range
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    table = df.sparkSession.createDataFrame([(heads[b], b, before[b]) for b in order], "hk bigint, hb int, first int")
    dealt = dealt.join(F.broadcast(table), (F.col("b") == F.col("hb")) & F.col("k").eqNullSafe(F.col("hk")), "left")  # a row a range
    own = F.struct(F.col("b"), F.lit(False).alias("ahead"))
    sent = dealt.withColumn("to", F.explode(F.when(F.col("first").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("first").alias("b"), F.lit(True).alias("ahead"))))))
    rows = sent.select(F.col("to.b").alias("b"), F.col("to.ahead").alias("ahead"), "k", "t").repartition(parts, "b").sortWithinPartitions("b", "ahead", "k", "t").withColumn("k", F.col("k").cast("string"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        held = None  # (b, key, text) that waits for what follows it
        for batch in batches:
            for b, ahead, k, t in zip(batch["b"], batch["ahead"], batch["k"], batch["t"]):
                if held is not None and held[0] == b:
                    yield held[1], held[2], t
                held = None if ahead else (b, k, t)
    return rows.mapInPandas(lambda batches: body(walk(batches)), schema)


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text", config: CwsConfig = CwsConfig()) -> DataFrame:
    """Each text's and its edited text's signature, and its likeness to the edited and to the next document's text.

    Null texts are empty; the signature of a text without words is all zeros; equal texts have equal signatures. A table
    of one row is followed by itself. The key must be an integer; another type raises a TypeError.
    """
    import hashlib

    def body(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out, last = [], None
        for k, t, following in rows:
            e = edited(t, following)
            mine, changed = sketch((t, e), config)
            if last is not None and last[1] == t:  # the row before waits for this row's signature
                last[0][6] = likeness(last[2], mine)
            elif last is not None:
                last[0][6] = likeness(last[2], sketch((last[1],), config)[0])
            row = [k, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(mine), to_hex(changed), likeness(mine, changed), None]
            out.append(row)
            last = (row, following, mine)
            if len(out) > 500:
                yield pd.DataFrame(out[:-1], columns=names)
                out = out[-1:]
        if last is not None:
            last[0][6] = likeness(last[2], sketch((last[1],), config)[0])
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    found = with_next(df, key, text, body, "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn("doc_id", F.col("doc_id").cast(dict(df.dtypes)[key]))


def op10_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
