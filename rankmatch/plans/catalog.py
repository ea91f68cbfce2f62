"""The registered queries, one or more for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.highlight import highlight_html, to_utf16
from ..functions.options import DEFAULT, PATHS, Case, Mode, Norm, Preset, Scoring
from ..operators.search import match_score
from ..sources.corpus import Corpus
from .more import QUERIES
from .oracle import search_sql

PART, CUSTOMER, PAGES, DOCUMENTS = ("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("pages", "page_id", "url"), ("documents", "doc_id", "text")
PREFER = replace(DEFAULT, prefer_prefix=True)
PREFER_PATHS = replace(PATHS, prefer_prefix=True)


@dataclass(frozen=True)
class Search:
    """A search over one column of one table, whose keys are dense from 0."""

    table: tuple[str, str, str]
    query: str
    mode: Mode = Mode.FUZZY
    scoring: Scoring = Scoring.FAST
    case: Case = Case.SMART
    norm: Norm = Norm.SMART
    preset: Preset = DEFAULT
    limit: int = 0
    oracle: bool = True

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = table_corpus(spark, sf_dir, self.table, self.preset)
        return corpus.find(self.mode, self.query, scoring=self.scoring, case=self.case, norm=self.norm, limit=self.limit).select("idx", "score")

    def sql(self) -> str:
        return search_sql(*self.table, self.query, self.mode, self.scoring, self.case, self.norm, self.preset, self.limit)


def table_corpus(spark: SparkSession, sf_dir: str, table: tuple[str, str, str], preset: Preset = DEFAULT) -> Corpus:
    name, key, text = table
    return Corpus.by_key(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, text), text, idx=F.col(key), preset=preset)


M, S = Mode, Scoring
SEARCHES: dict[str, Search] = {
    # match modes without scores
    "exact_off": Search(PART, "red widget", M.EXACT, S.OFF),
    "prefix_off": Search(PART, "red", M.PREFIX, S.OFF, limit=50),
    "postfix_off": Search(PART, "widget", M.POSTFIX, S.OFF),
    "substring_off": Search(CUSTOMER, "00012", M.SUBSTRING, S.OFF),
    "fuzzy_off": Search(PART, "rdwg", M.FUZZY, S.OFF),
    "fuzzy_off_limit": Search(PART, "sl", M.FUZZY, S.OFF, limit=20),
    "documents_substring_off": Search(DOCUMENTS, "token =", M.SUBSTRING, S.OFF),
    "documents_fuzzy_off": Search(DOCUMENTS, "akiaz", M.FUZZY, S.OFF),
    # literal modes with scores
    "exact_score": Search(PART, "blue gear", M.EXACT),
    "prefix_score": Search(PAGES, "http://", M.PREFIX),
    "postfix_score": Search(PART, "gear", M.POSTFIX),
    "substring_score": Search(PAGES, "example", M.SUBSTRING),
    "substring_documents": Search(DOCUMENTS, "licensed", M.SUBSTRING),
    # fuzzy, by model
    "fuzzy_fast": Search(PART, "rdg"),
    "fuzzy_fast_topk": Search(PART, "bg", limit=50),
    "fuzzy_fast_longgap": Search(PAGES, "h9"),
    "fuzzy_fast_documents": Search(DOCUMENTS, "tok", oracle=False),
    "fuzzy_one_char": Search(PART, "w"),
    "fuzzy_customer_digits": Search(CUSTOMER, "cu17"),
    "fuzzy_nucleo": Search(PART, "sml", scoring=S.NUCLEO),
    "fuzzy_nucleo_urls": Search(PAGES, "exco", scoring=S.NUCLEO),
    "fuzzy_nucleo_topk": Search(CUSTOMER, "c0", scoring=S.NUCLEO, limit=50),
    "fuzzy_no_hit": Search(PART, "zznotfound"),
    # the query language
    "query_and": Search(PART, "re wi"),
    "query_negate": Search(PART, "re !wid"),
    "query_negative_only": Search(PART, "!red"),
    "query_operators": Search(PART, "^bl ar$ !'reen"),
    "query_exact_anchors": Search(PART, "^red$"),
    "query_escaped": Search(PART, "red\\ wi"),
    "empty_query": Search(PART, " "),
    "literal_spaces": Search(PART, "d w", M.SUBSTRING),
    # case and diacritics
    "case_respect": Search(DOCUMENTS, "Licensed", M.SUBSTRING, S.OFF, case=Case.RESPECT),
    "case_ignore": Search(DOCUMENTS, "LICENSED", M.SUBSTRING, S.OFF, case=Case.IGNORE),
    "case_smart": Search(DOCUMENTS, "Released", M.SUBSTRING, S.OFF),
    "norm_never": Search(DOCUMENTS, "eaux", M.SUBSTRING, S.OFF, norm=Norm.NEVER),
    "norm_smart": Search(DOCUMENTS, "eeaux", M.SUBSTRING, S.OFF),
    "norm_asymmetric": Search(DOCUMENTS, "éeaux", M.SUBSTRING, S.OFF),
    "norm_prefix_score": Search(DOCUMENTS, "e", M.PREFIX, case=Case.IGNORE),
    # presets
    "paths_preset": Search(PAGES, "/en/", M.SUBSTRING, preset=PATHS),
    "paths_fuzzy": Search(PAGES, "ecn", scoring=S.NUCLEO, preset=PATHS),
    "prefer_prefix": Search(PAGES, "tex", preset=PREFER),
    "prefer_prefix_nucleo": Search(PAGES, "ecm", scoring=S.NUCLEO, preset=PREFER),
    "prefer_prefix_literal": Search(PAGES, "com", M.SUBSTRING, preset=PREFER_PATHS),
}


def by_keys_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return Corpus.by_keys(df, ["c_name", "c_mktsegment"], idx=F.col("c_custkey")).fuzzy("ue").select("idx", "score", "matched_kind", "matched_key")


def _best_sql(table: str, key: str, fields: list[str], query: str, mode: Mode = Mode.FUZZY, scoring: Scoring = Scoring.FAST) -> str:
    each = " UNION ALL ".join(f"SELECT *, {i}::INT AS matched_key FROM ({search_sql(table, key, f, query, mode, scoring)})" for i, f in enumerate(fields))
    return f"SELECT idx, score, CASE WHEN matched_key = 0 THEN 0 ELSE 100 END::INT AS matched_kind, matched_key FROM ({each}) QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, matched_key) = 1"


def by_keys_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    return Corpus.by_keys(df, ["p_name", "p_brand", "p_type"], idx=F.col("p_partkey")).substring("an", scoring=S.OFF).select("idx", "score", "matched_kind", "matched_key")


def raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_corpus(spark, sf_dir, PART).fuzzy_raws("gz", limit=50)


def one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_corpus(spark, sf_dir, PART).fuzzy("gdg", limit=1).select("idx", "score", "matched_kind", "matched_key")


def highlight_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table_corpus(spark, sf_dir, PART).prefix("red", highlight=True, limit=50)
    return hits.select("idx", "score", F.array_join("indices", ",").alias("indices"))


def highlight_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table_corpus(spark, sf_dir, PART).fuzzy("rw", scoring=S.OFF, highlight=True)
    return hits.select("idx", F.array_join("indices", ",").alias("indices"))


def highlight_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table_corpus(spark, sf_dir, PAGES).fuzzy("exco", scoring=S.NUCLEO, highlight=True, limit=50)
    return hits.select("idx", "score", F.array_join("indices", ",").alias("indices"))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table_corpus(spark, sf_dir, PART).prefix("red", highlight=True, limit=50)
    return hits.select("idx", highlight_html(F.col("raw.p_name"), F.col("indices")).alias("html"))


def utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table_corpus(spark, sf_dir, PART).prefix("red", highlight=True, limit=50)
    return hits.select("idx", F.array_join(to_utf16(F.col("raw.p_name"), F.col("indices")), ",").alias("offsets"))


def _nations(spark: SparkSession, sf_dir: str, name: str = "nation", letter: str = "n") -> Corpus:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(f"{letter}_name")
    return Corpus.by_key(df, f"{letter}_name", order=[F.col(f"{letter}_name")])


def build_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).items.select("idx", "text")


def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("n_name"))
    more = Corpus.by_key(regions, "n_name", order=[F.col("n_name")])
    return _nations(spark, sf_dir).append(more).items.select("idx", "text")


def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).update(3, "elsewhere").items.select("idx", "text")


def remove_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).remove_at(2).items.select("idx", "text")


def remove_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, gone = _nations(spark, sf_dir).remove_where(F.col("text").contains("1"))
    return kept.items.select("idx", "text", F.lit(gone).cast("bigint").alias("removed"))


def alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated keys: the name reversed, as kind 2."""
    keyed = table_corpus(spark, sf_dir, PART).with_keys(lambda t: [(2, F.reverse(t))])
    return keyed.prefix("tegdiw", scoring=S.OFF).select("idx", "matched_kind", "matched_key")


def length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_corpus(spark, sf_dir, PART).items.agg(F.count("*").alias("n"))


MANY = ["gems", "red", "wid", "gear", "sp", "blue b", "NOTFOUND"]


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_corpus(spark, sf_dir, PART).many(MANY, limit=50).select("query", "idx", "score", F.col("rank").cast("bigint").alias("rank"))


def column_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_brand", match_score(F.col("p_name"), "rg").alias("s")).where("s >= 0").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("s").alias("top"))


_RED = search_sql(*PART, "red", Mode.PREFIX, limit=50)
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "by_keys_best": (by_keys_best, _best_sql("customer", "c_custkey", ["c_name", "c_mktsegment"], "ue")),
    "by_keys_off": (by_keys_off, _best_sql("part", "p_partkey", ["p_name", "p_brand", "p_type"], "an", Mode.SUBSTRING, S.OFF)),
    "raws": (raws, f"SELECT p_partkey, p_name FROM part JOIN ({search_sql(*PART, 'gz', limit=50)}) ON idx = p_partkey"),
    "one": (one, f"SELECT idx, score, 0::INT AS matched_kind, 0::INT AS matched_key FROM ({search_sql(*PART, 'gdg', limit=1)})"),
    "highlight_literal": (highlight_literal, f"SELECT idx, score, '0,1,2' AS indices FROM ({_RED})"),
    "highlight_off": (highlight_off, "SELECT p_partkey AS idx, (instr(p_name, 'r') - 1) || ',' || (instr(p_name, 'r') + instr(substr(p_name, instr(p_name, 'r') + 1), 'w') - 1) AS indices FROM part WHERE regexp_matches(p_name, 'r.*w')"),
    "highlight_fuzzy": (highlight_fuzzy, None),
    "html": (html, f"SELECT idx, '<mark>' || left(p_name, 3) || '</mark>' || substr(p_name, 4) AS html FROM ({_RED}) JOIN part ON p_partkey = idx"),
    "utf16": (utf16, f"SELECT idx, '0,1,2' AS offsets FROM ({_RED})"),
    "build_dense": (build_dense, "SELECT row_number() OVER (ORDER BY n_name) - 1 AS idx, n_name AS text FROM nation"),
    "append": (append, "SELECT row_number() OVER (ORDER BY n_name) - 1 AS idx, n_name AS text FROM nation UNION ALL SELECT row_number() OVER (ORDER BY r_name) - 1 + (SELECT count(*) FROM nation), r_name FROM region"),
    "update": (update, "SELECT idx, CASE WHEN idx = 3 THEN 'elsewhere' ELSE text END AS text FROM (SELECT row_number() OVER (ORDER BY n_name) - 1 AS idx, n_name AS text FROM nation)"),
    "remove_at": (remove_at, "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, text FROM (SELECT row_number() OVER (ORDER BY n_name) - 1 AS idx, n_name AS text FROM nation) WHERE idx <> 2"),
    "remove_where": (remove_where, "SELECT row_number() OVER (ORDER BY n_name) - 1 AS idx, n_name AS text, (SELECT count(*) FROM nation WHERE contains(n_name, '1')) AS removed FROM nation WHERE NOT contains(n_name, '1')"),
    "alternates": (alternates, "SELECT p_partkey AS idx, 2::INT AS matched_kind, 1::INT AS matched_key FROM part WHERE ends_with(p_name, 'widget')"),
    "length": (length, "SELECT count(*) AS n FROM part"),
    "batch": (batch, " UNION ALL ".join(f"SELECT '{q}' AS query, idx, score, row_number() OVER (ORDER BY score DESC, idx) AS rank FROM ({search_sql(*PART, q, limit=50)})" for q in MANY)),
    **QUERIES,
    "column_function": (column_function, f"SELECT p_brand, count(*) AS n, max(score)::INT AS top FROM ({search_sql(*PART, 'rg')}) JOIN part ON p_partkey = idx GROUP BY p_brand"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEARCHES["fuzzy_fast_topk"].spark(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: s.spark for name, s in SEARCHES.items()} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s.sql() for name, s in SEARCHES.items() if s.oracle} | {name: sql for name, (_, sql) in OTHERS.items() if sql}
