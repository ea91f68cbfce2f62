"""A corpus: an ordered table of items, each with an original key and perhaps further ones. Every change makes a new one."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.options import DEFAULT, PATHS, ClosedCorpusError, KeyKind, Mode, Preset, SearchKey, SearchOptions
from ..operators.batch import search_many
from ..operators.search import search
from ..plans.session import dense_index, durable

KEYS = "array<struct<kind:int,text:string>>"
_pool = ThreadPoolExecutor(max_workers=8, thread_name_prefix="rankmatch")


def as_text(column: Column) -> Column:
    """Null is the empty string; other types are cast."""
    return F.coalesce(column.cast("string"), F.lit(""))


@dataclass
class _State:
    closed: bool = False


@dataclass(frozen=True)
class Corpus:
    """``items``: idx (dense, from 0), text, keys, raw (the source row). ``keyed``: whether any item may have further keys."""

    items: DataFrame
    keyed: bool = False
    options: SearchOptions = SearchOptions()
    preset: Preset = DEFAULT
    text_of: Callable[[], Column] | None = None
    _state: _State = field(default_factory=_State, compare=False, repr=False)

    # --- building ---
    @staticmethod
    def of(df: DataFrame, text: Column, order: Iterable[Column] | None = None, idx: Column | None = None, keys: Column | None = None, options: SearchOptions = SearchOptions(), match_paths: bool = False, prefer_prefix: bool = False, preset: Preset | None = None) -> Corpus:
        """Rows of ``df`` as items. ``idx`` must be dense already, or ``order`` gives the order from which it is made."""
        preset = preset or replace(PATHS if match_paths else DEFAULT, prefer_prefix=prefer_prefix)
        raw = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("raw")
        body = df.select(raw, as_text(text).alias("text"), (F.lit(None).cast(KEYS) if keys is None else keys.cast(KEYS)).alias("keys"), *([idx.cast("bigint").alias("idx")] if idx is not None else []), *([c.alias(f"__o{i}") for i, c in enumerate(order or [])] if idx is None else []))
        if idx is None:
            names = [c for c in body.columns if c.startswith("__o")]
            if not names:
                raise ValueError("give idx or order: a table has no order of its own")
            body = dense_index(body, *map(F.col, names)).drop(*names)
        return Corpus(body.select("idx", "text", F.coalesce("keys", F.expr(f"cast(array() as {KEYS})")).alias("keys"), "raw"), keys is not None, options, preset)

    @staticmethod
    def strings(spark: SparkSession, items: Iterable[str], **kwargs) -> Corpus:
        df = spark.createDataFrame([(i, s) for i, s in enumerate(items)], "i bigint, value string")
        return Corpus.of(df, F.col("value"), idx=F.col("i"), **kwargs)

    @staticmethod
    def by_key(df: DataFrame, name: str, **kwargs) -> Corpus:
        """One field; dotted names reach into structs; null is the empty string."""
        return Corpus.of(df, F.col(name), **kwargs)

    @staticmethod
    def by_keys(df: DataFrame, names: list[str], **kwargs) -> Corpus:
        """The first field is the original key, the others are keys of kind CUSTOM."""
        if not names:
            raise ValueError("by_keys needs a field")
        more = F.array(*(F.struct(F.lit(int(KeyKind.CUSTOM)).alias("kind"), as_text(F.col(n)).alias("text")) for n in names[1:]))
        return Corpus.of(df, F.col(names[0]), keys=more if len(names) > 1 else None, **kwargs)

    def with_keys(self, generate: Callable[[Column], list[tuple[int, Column]]], max_keys: int = 8) -> Corpus:
        """Keys made from every item's text, such as transliterations; at most ``max_keys`` an item, after those it has."""
        made = [F.struct(F.lit(int(kind)).alias("kind"), as_text(c).alias("text")) for kind, c in generate(F.col("text"))][:max_keys]
        return self._with(self.items.withColumn("keys", F.concat("keys", F.array(*made).cast(KEYS))), keyed=True) if made else self

    # --- life cycle ---
    def _with(self, items: DataFrame, keyed: bool | None = None) -> Corpus:
        self._open()
        return replace(self, items=items, keyed=self.keyed if keyed is None else keyed, _state=_State())

    def _open(self) -> None:
        if self._state.closed:
            raise ClosedCorpusError("the corpus was closed")

    def persist(self) -> Corpus:
        self._open()
        self.items.persist()
        return self

    def close(self) -> None:
        """May be called again; any other use afterwards raises."""
        if not self._state.closed:
            self.items.unpersist()
            self._state.closed = True

    def __enter__(self) -> Corpus:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def length(self) -> int:
        self._open()
        return self.items.count()

    # --- changes ---
    def _local(self, rows: list[tuple], first: int) -> DataFrame:
        spark = self.items.sparkSession
        raw = dict(self.items.dtypes)["raw"]
        df = spark.createDataFrame([(first + i, t, [(int(k.kind), k.text) for k in keys]) for i, (t, keys) in enumerate(rows)], f"idx bigint, text string, keys {KEYS}")
        fields = self.items.schema["raw"].dataType.fields
        shown = [F.col("text").cast(f.dataType).alias(f.name) if f.dataType.typeName() == "string" else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return df.withColumn("raw", F.struct(*shown).cast(raw))

    def add(self, text: str, keys: Iterable[SearchKey] = ()) -> Corpus:
        return self.add_all([text], [list(keys)])

    def add_key(self, text: str, keys: Iterable[SearchKey]) -> Corpus:
        return self.add(text, keys)

    def add_all(self, texts: Iterable[str], keys: list[list[SearchKey]] | None = None) -> Corpus:
        """Items at the end, in their order."""
        texts = list(texts)
        keys = keys or [[] for _ in texts]
        return self._with(self.items.unionByName(self._local(list(zip(texts, keys)), self.length())), self.keyed or any(keys))

    def add_all_async(self, texts: Iterable[str]) -> Future[Corpus]:
        """``add_all`` in the background; this corpus stays as it is, so a failure needs no undoing."""

        def run() -> Corpus:
            made = self.add_all(texts).persist()
            try:
                made.length()
            except Exception:
                made.close()
                raise
            return made

        return _pool.submit(run)

    def append(self, other: Corpus) -> Corpus:
        """The other corpus's items at the end; its rows must have the same columns."""
        n = self.length()
        return self._with(self.items.unionByName(other.items.withColumn("idx", F.col("idx") + n)), self.keyed or other.keyed)

    def update(self, index: int, text: str) -> Corpus:
        """Another text in one place; that item's further keys go."""
        self._check(index)
        here = F.col("idx") == index
        none = F.expr(f"cast(array() as {KEYS})")
        return self._with(self.items.withColumn("text", F.when(here, F.lit(text)).otherwise(F.col("text"))).withColumn("keys", F.when(here, none).otherwise(F.col("keys"))))

    def remove_at(self, index: int) -> Corpus:
        self._check(index)
        return self._with(self.items.where(F.col("idx") != index).withColumn("idx", F.col("idx") - (F.col("idx") > index).cast("bigint")))

    def remove_where(self, predicate: Column) -> tuple[Corpus, int]:
        """Without the items for which ``predicate`` (over idx, text, keys, raw) holds, and their number."""
        kept = durable(self.items.where(~F.coalesce(predicate, F.lit(False))))
        gone = self.length() - kept.count()
        return self._with(dense_index(kept.withColumnRenamed("idx", "__was"), F.col("__was")).drop("__was").select("idx", "text", "keys", "raw")), gone

    def refresh(self, text: Column | None = None, source: Corpus | None = None) -> Corpus:
        """Texts computed anew from ``raw``, or all items replaced; further keys go."""
        if source is not None:
            return self._with(source.items, source.keyed)
        fresh = self.items.withColumn("text", as_text(text if text is not None else F.col("text")))
        return self._with(fresh.withColumn("keys", F.expr(f"cast(array() as {KEYS})")), False)

    def clear(self) -> Corpus:
        return self._with(self.items.limit(0), False)

    def _check(self, index: int) -> None:
        if not 0 <= index < self.length():
            raise IndexError(f"no item {index}")

    # --- searching ---
    def find(self, mode: Mode, query: str, **options) -> DataFrame:
        self._open()
        return search(self.items, query, mode, self.options.merged(**options), self.preset, self.keyed)

    def fuzzy(self, query: str, **options) -> DataFrame:
        return self.find(Mode.FUZZY, query, **options)

    def substring(self, query: str, **options) -> DataFrame:
        return self.find(Mode.SUBSTRING, query, **options)

    def prefix(self, query: str, **options) -> DataFrame:
        return self.find(Mode.PREFIX, query, **options)

    def postfix(self, query: str, **options) -> DataFrame:
        return self.find(Mode.POSTFIX, query, **options)

    suffix = postfix

    def exact(self, query: str, **options) -> DataFrame:
        return self.find(Mode.EXACT, query, **options)

    def raws(self, mode: Mode, query: str, **options) -> DataFrame:
        """The source rows of the hits, in their order, without scores."""
        return self.find(mode, query, **options | {"highlight": False}).select("raw.*")

    def fuzzy_raws(self, query: str, **options) -> DataFrame:
        return self.raws(Mode.FUZZY, query, **options)

    def substring_raws(self, query: str, **options) -> DataFrame:
        return self.raws(Mode.SUBSTRING, query, **options)

    def prefix_raws(self, query: str, **options) -> DataFrame:
        return self.raws(Mode.PREFIX, query, **options)

    def postfix_raws(self, query: str, **options) -> DataFrame:
        return self.raws(Mode.POSTFIX, query, **options)

    suffix_raws = postfix_raws

    def exact_raws(self, query: str, **options) -> DataFrame:
        return self.raws(Mode.EXACT, query, **options)

    def submit(self, mode: Mode, query: str, raws: bool = False, **options) -> Future[list[Row]]:
        """A search in the background; several may run at once."""
        df = self.raws(mode, query, **options) if raws else self.find(mode, query, **options)
        return _pool.submit(df.collect)

    def many(self, queries: list[str], mode: Mode = Mode.FUZZY, **options) -> DataFrame:
        """The best hits of many queries in one scan, over all keys."""
        self._open()
        return search_many(self.items, queries, mode, self.options.merged(**options), self.preset, self.keyed)

    @property
    def one(self) -> One:
        return One(self)


def build_async(build: Callable[[], Corpus]) -> Future[Corpus]:
    """A corpus made and persisted in the background; a failure leaves nothing behind."""

    def run() -> Corpus:
        made = build().persist()
        try:
            made.length()
        except Exception:
            made.close()
            raise
        return made

    return _pool.submit(run)


@dataclass(frozen=True)
class One:
    """The best hit, or None: ``fuzzy``, ``fuzzy_raw``, ``fuzzy_async``, ``fuzzy_raw_async`` and so for every mode."""

    corpus: Corpus

    def find(self, mode: Mode, query: str, **options) -> Row | None:
        return self.corpus.find(mode, query, **options | {"limit": 1}).first()

    def raw(self, mode: Mode, query: str, **options) -> Row | None:
        return self.corpus.raws(mode, query, **options | {"limit": 1}).first()


def _many(mode: Mode, raws: bool):
    def method(self: Corpus, query: str, **options) -> Future[list[Row]]:
        return self.submit(mode, query, raws, **options)

    return method


def _one(mode: Mode, raw: bool, wait: bool):
    def method(self: One, query: str, **options):
        find = self.raw if raw else self.find
        return find(mode, query, **options) if wait else _pool.submit(find, mode, query, **options)

    return method


for _mode in Mode:
    for _name in (_mode.value, *(["suffix"] if _mode == Mode.POSTFIX else [])):
        setattr(Corpus, f"{_name}_async", _many(_mode, False))
        setattr(Corpus, f"{_name}_raws_async", _many(_mode, True))
        for _raw, _wait in ((False, True), (True, True), (False, False), (True, False)):
            setattr(One, f"{_name}{'_raw' * _raw}{'' if _wait else '_async'}", _one(_mode, _raw, _wait))
