"""Language identification with hyperdimensional profiles.

Every letter has a seeded random vector of signs. An n-gram's vector binds (multiplies) the letters' vectors, each rotated
by its place; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles its training texts.
A text has the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import col, small_batches


@dataclass(frozen=True)
class LangConfig:
    """``least_score``: the pipeline's stage rejects texts of ``long_text`` characters or more whose best cosine is lower."""

    dims: int = 1024
    seed: int = 11
    chunk_chars: int = 100_000
    cache_rows: int = 1 << 14
    least_score: float = 0.05
    long_text: int = 500


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower-case letter, or 0 if it is no letter."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            lower[c] = ord(low) if len(low := s.lower()) == 1 else c
    return lower, lower > 0


class Space:
    """Letters' and n-grams' vectors, made when first met and kept per worker."""

    def __init__(self, config: LangConfig):
        self.config, self.index = config, {0: 0}
        self.letters = [self._letter(0)]
        self.rows, self.rolled = np.full(1 << 21, -1, dtype=np.int32), None
        self.bound, self.used = np.empty((config.cache_rows, config.dims), dtype=np.int8), 0

    def _letter(self, c: int) -> np.ndarray:
        return np.random.default_rng([self.config.seed, c]).integers(0, 2, self.config.dims, dtype=np.int8) * 2 - 1

    def symbols(self, cps: np.ndarray) -> np.ndarray:
        found, inverse = _unique(cps)
        for c in found:
            if int(c) not in self.index:
                self.index[int(c)] = len(self.letters)
                self.letters.append(self._letter(int(c)))
                self.rolled = None
        return np.array([self.index[int(c)] for c in found], dtype=np.int64)[inverse]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as packed symbols of 21 bits each."""
        if self.rolled is None:
            base = np.array(self.letters)
            self.rolled = [np.roll(base, k, axis=1) for k in (2, 1, 0)]
        a, b, c = grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF
        return self.rolled[0][a] * self.rolled[1][b] * self.rolled[2][c]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) > len(self.bound) or len(self.letters) > 128:
            return self.bind(grams).astype(np.float32)
        at = grams >> 42 << 14 | (grams >> 21 & 127) << 7 | grams & 127
        new = np.flatnonzero(self.rows[at] < 0)
        if self.used + len(new) > len(self.bound):
            self.rows[:], self.used, new = -1, 0, np.arange(len(grams))
        self.bound[self.used : self.used + len(new)] = self.bind(grams[new])
        self.rows[at[new]] = np.arange(self.used, self.used + len(new))
        self.used += len(new)
        return self.bound[self.rows[at]].astype(np.float32)


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, without sorting where the values are small."""
    if len(x) and 0 <= x.min() and (top := int(x.max())) < 1 << 22:
        there = np.zeros(top + 1, dtype=bool)
        there[x] = True
        found = np.flatnonzero(there)
        place = np.empty(top + 1, dtype=np.int64)
        place[found] = np.arange(len(found))
        return found, place[x]
    return np.unique(x, return_inverse=True)


def grams_of(space: Space, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams, counts[text, n-gram], has a letter) of a chunk of texts; runs of non-letters are one blank."""
    lower, _ = _tables()
    coded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lengths = np.array([len(x) + 2 for x in coded])
    cps = np.zeros(lengths.sum(), dtype=np.uint32)
    ends = np.cumsum(lengths)
    for x, end in zip(coded, ends):
        cps[end - 1 - len(x) : end - 1] = lower[x]
    doc = np.repeat(np.arange(len(texts)), lengths)
    keep = np.ones(len(cps), dtype=bool)
    keep[1:] = (cps[1:] > 0) | (cps[:-1] > 0) | (doc[1:] != doc[:-1])
    cps, doc = cps[keep], doc[keep]
    has = np.bincount(doc, weights=cps > 0, minlength=len(texts)) > 0
    s = space.symbols(cps)
    if len(s) < 3:
        return np.empty(0, np.int64), np.zeros((len(texts), 0), np.float32), has
    within = doc[2:] == doc[:-2]
    a, b, c, doc = s[:-2][within], s[1:-1][within], s[2:][within], doc[2:][within]
    n = len(space.letters)
    found, inverse = _unique((a * n + b) * n + c)
    counts = np.bincount(doc * len(found) + inverse, minlength=len(texts) * len(found)).reshape(len(texts), len(found))
    return found // (n * n) << 42 | found // n % n << 21 | found % n, counts.astype(np.float32), has


def _chunks(texts: list[str], limit: int) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > limit or i - start >= 128):
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang", config: LangConfig = LangConfig()) -> dict[str, np.ndarray]:
    """Prototypes of all languages in ``df``. Sums are of whole numbers: no order of rows or tasks changes them.

    Each task sends one vector per language; they are added natively, and languages times dimensions numbers are collected.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = Space(config), {}
        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].to_numpy()
            for part in _chunks(texts, config.chunk_chars):
                grams, counts, _ = grams_of(space, texts[part])
                names, which = np.unique(langs[part].astype(str), return_inverse=True)
                by = np.zeros((len(names), len(grams)), dtype=np.float32)
                np.add.at(by, which, counts)
                for name, v in zip(names, by @ space.vectors(grams)):
                    sums[name] = sums.get(name, 0) + np.rint(v).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    small_batches(df.sparkSession)
    rows = df.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
    summed = rows.mapInPandas(bundle, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["lang"], np.zeros(config.dims))[r["i"]] = r["x"]
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(out.items())}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", config: LangConfig = LangConfig()) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (cosine, 0 to 1); columns of these names are replaced.

    Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with score 0. Ties go to the
    first language by name. A prediction depends on the text alone, and texts are read whole.
    """
    names, matrix = list(prototypes), np.array([*prototypes.values()], dtype=np.float32).T

    @F.pandas_udf("struct<lang:string,score:double>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = Space(config)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            got, scores = [], []
            for part in _chunks(texts, config.chunk_chars):
                grams, counts, has = grams_of(space, texts[part])
                v = counts @ space.vectors(grams) if len(grams) else np.zeros((len(has), config.dims), np.float32)
                cos = (v @ matrix / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]).round(6) if names else np.zeros((len(has), 1))
                top = cos.argmax(axis=1)
                got += [names[k] if names and h else "und" for k, h in zip(top, has)]
                scores += [float(x) if h else 0.0 for x, h in zip(np.clip(cos[np.arange(len(top)), top], 0, 1), has)]
            yield pd.DataFrame({"lang": got, "score": scores})

    small_batches(df.sparkSession)
    out = df.withColumn("__best", best.asNondeterministic()(col(text).cast("string")))  # else a filter on the result predicts twice
    return out.withColumn("lang_pred", F.col("__best.lang")).withColumn("score", F.col("__best.score")).drop("__best")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    known = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), known).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
