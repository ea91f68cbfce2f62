"""Further registered queries, whose SQL is written by hand: no pattern, table or score of it comes from this library."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.options import DEFAULT, Case, KeyKind, Mode, Norm, Scoring, SearchKey, SearchOptions
from ..operators.search import match_indices
from ..sources.corpus import Corpus, build_async
from .session import durable

WORDS = ["gear", "Widget", "", "bolt case", "crème", "日本"]
LONG = "red " * 700


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def part_corpus(spark: SparkSession, sf_dir: str, text: Column | None = None, **kwargs) -> Corpus:
    df = read(spark, sf_dir, "part", "p_partkey", "p_name")
    return Corpus.of(df, F.col("p_name") if text is None else text, idx=F.col("p_partkey"), **kwargs)


def nation_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.by_key(read(spark, sf_dir, "nation", "n_name"), "n_name", order=[F.col("n_name")])


def supplier_corpus(spark: SparkSession, sf_dir: str, text: Column, tasks: int | None = None) -> Corpus:
    """``tasks``: the keys are dealt to so many before texts are made of them, for a small file is one task; a mere repartition lets filters on the texts move below it."""
    keys = read(spark, sf_dir, "supplier", "s_suppkey")
    return Corpus.of(durable(keys.repartition(tasks)) if tasks else keys, text, idx=F.col("s_suppkey"))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.strings(spark, WORDS).items.select("idx", "text")


def asynchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built and added to in the background."""
    made = build_async(lambda: nation_corpus(spark, sf_dir)).result()
    return made.add_all_async(WORDS).result().items.select("idx", "text")


def add_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two single additions; the query finds the second by a further key only."""
    c = nation_corpus(spark, sf_dir).add("dong gate").add_key("東", [SearchKey("tou", KeyKind.ROMAJI), SearchKey("dong")])
    return c.exact("dong").unionByName(c.prefix("dong g")).select("idx", "score", "matched_kind", "matched_key")


def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_corpus(spark, sf_dir).refresh(F.upper("raw.p_name")).items.select("idx", "text")


def clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_corpus(spark, sf_dir).clear().add("alone").items.select("idx", "text")


PADDED = ("' ' || chr(9) || p_name || chr(160) || chr(10)", lambda: F.concat(F.lit(" \t"), "p_name", F.lit(" \n")))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space around a text doesn't hinder anchors, unless the query has some there."""
    c = part_corpus(spark, sf_dir, PADDED[1]())
    found = [c.find(m, q).select("idx", "score", F.lit(n).alias("search")) for n, m, q in (("prefix", Mode.PREFIX, "red"), ("postfix", Mode.POSTFIX, "widget"), ("exact", Mode.EXACT, "red widget"), ("kept", Mode.PREFIX, " red"), ("kept tab", Mode.PREFIX, " \tred"))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def exact_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = part_corpus(spark, sf_dir)
    return c.fuzzy("^red\\ widget$").unionByName(c.fuzzy("'blue\\ gear$")).select("idx", "score")


def most_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 words count; what stands after them is dropped."""
    return part_corpus(spark, sf_dir).fuzzy(" ".join(["^red"] * 64 + ["nothing"] * 6)).select("idx", "score")


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("red "), 700), F.col("s_suppkey").cast("string"))
    return supplier_corpus(spark, sf_dir, text).prefix(LONG).select("idx", "score")


def greedy(spark: SparkSession, sf_dir: str, scoring: Scoring) -> DataFrame:
    """Windows beyond the matrix: the score is that of the leftmost reading."""
    key = F.col("s_suppkey")
    end = F.when(key % 3 == 0, " b").when(key % 3 == 1, "/b").otherwise("xb")
    text = F.concat(F.lit("a"), F.repeat(F.lit("."), (key % 7 + 60_000).cast("int")), end)
    return supplier_corpus(spark, sf_dir, text, 4 * spark.sparkContext.defaultParallelism).fuzzy("ab", scoring=scoring).select("idx", "score")


GREEDY_SQL = "SELECT s_suppkey AS idx, CASE s_suppkey % 3 WHEN 0 THEN 26 WHEN 1 THEN 25 ELSE 16 END::INT AS score FROM supplier"


def fast_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = part_corpus(spark, sf_dir).fuzzy("dg", scoring=Scoring.FAST, highlight=True)
    return hits.select("idx", F.array_join("indices", ",").alias("indices"))


def index_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_indices(F.col("p_name"), "dg", options=SearchOptions(scoring=Scoring.OFF))
    return read(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("idx"), F.array_join(found, ",").alias("indices"))


def nucleo_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = part_corpus(spark, sf_dir).fuzzy("eg", scoring=Scoring.NUCLEO, highlight=True)
    return hits.select("idx", "score", F.array_join("indices", ",").alias("indices"))


def tables(unicode: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = Corpus.by_key(read(spark, sf_dir, "documents", "doc_id", "text"), "text", idx=F.col("doc_id"), preset=replace(DEFAULT, unicode=unicode))
        return c.substring("É", scoring=Scoring.OFF, case=Case.IGNORE, norm=Norm.NEVER).select("idx", "score")

    return query


MANY = ["^an", "widget$", "'brand"]


def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    hits = Corpus.by_keys(df, ["p_name", "p_brand"], idx=F.col("p_partkey")).many(MANY, scoring=Scoring.OFF)
    return hits.select("query", "idx", "matched_kind", "matched_key", F.col("rank").cast("bigint").alias("rank"))


_NATIONS = "SELECT row_number() OVER (ORDER BY n_name) - 1 AS idx, n_name AS text FROM nation"
_WORDS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS))
_FIRST_D = "instr(p_name, 'd')"
_G = f"({_FIRST_D} + instr(substr(p_name, {_FIRST_D} + 1), 'g'))"
_CELLS = """SELECT p_partkey AS idx, i, substr(p_name, i::INT + 1, 1) AS c, CASE WHEN i = 0 OR substr(p_name, i::INT, 1) = ' ' THEN 10 ELSE 0 END AS b
    FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS i FROM part WHERE p_name IS NOT NULL)"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "strings": (strings, f"SELECT idx::BIGINT AS idx, text FROM (VALUES {_WORDS}) t(idx, text)"),
    "asynchronous": (asynchronous, f"{_NATIONS} UNION ALL SELECT (SELECT count(*) FROM nation) + idx, text FROM (VALUES {_WORDS}) t(idx, text)"),
    "add_keys": (add_keys, "SELECT count(*) + 1 AS idx, 114::INT AS score, 1::INT AS matched_kind, 2::INT AS matched_key FROM nation UNION ALL SELECT count(*), 166::INT, 0, 0 FROM nation"),
    "refresh": (refresh, "SELECT p_partkey AS idx, upper(coalesce(p_name, '')) AS text FROM part"),
    "clear": (clear, "SELECT 0::BIGINT AS idx, 'alone' AS text"),
    "trimmed": (
        trimmed,
        """SELECT p_partkey AS idx, 88::INT AS score, 'prefix' AS search FROM part WHERE starts_with(p_name, 'red')
        UNION ALL SELECT p_partkey, CASE WHEN p_name = 'widget' OR ends_with(p_name, ' widget') THEN 166 ELSE 116 END::INT, 'postfix' FROM part WHERE ends_with(p_name, 'widget')
        UNION ALL SELECT p_partkey, 270::INT, 'exact' FROM part WHERE p_name = 'red widget'
        UNION ALL SELECT p_partkey, 140::INT, 'kept tab' FROM part WHERE starts_with(p_name, 'red')""",
    ),
    "exact_anchors": (exact_anchors, "SELECT p_partkey AS idx, CASE p_name WHEN 'red widget' THEN 270 ELSE 244 END::INT AS score FROM part WHERE p_name IN ('red widget', 'blue gear') AND length(p_name) IN (9, 10)"),
    "most_atoms": (most_atoms, "SELECT p_partkey AS idx, (64 * 88)::INT AS score FROM part WHERE starts_with(p_name, 'red')"),
    "saturation": (saturation, "SELECT s_suppkey AS idx, 65535::INT AS score FROM supplier"),
    "greedy_fast": (lambda spark, sf_dir: greedy(spark, sf_dir, Scoring.FAST), GREEDY_SQL),
    "greedy_nucleo": (lambda spark, sf_dir: greedy(spark, sf_dir, Scoring.NUCLEO), GREEDY_SQL),
    "fast_positions": (fast_positions, f"SELECT p_partkey AS idx, (g - 1 - instr(reverse(left(p_name, g::INT - 1)), 'd')) || ',' || (g - 1) AS indices FROM (SELECT *, {_G} AS g FROM part WHERE regexp_matches(p_name, 'd.*g'))"),
    "index_column": (index_column, f"SELECT p_partkey AS idx, CASE WHEN regexp_matches(p_name, 'd.*g') THEN ({_FIRST_D} - 1) || ',' || ({_G} - 1) ELSE '' END AS indices FROM part"),
    "nucleo_positions": (
        nucleo_positions,
        f"""WITH cells AS ({_CELLS}),
        pairs AS (SELECT a.idx, a.i AS i, z.i AS j, 16 + 2 * a.b AS h, z.i = a.i + 1 AS beside,
            CASE WHEN z.i = a.i + 1 THEN 16 + 2 * a.b + 16 + greatest(a.b, z.b, 4) ELSE greatest(0, 16 + 2 * a.b - 3 - (z.i - a.i - 2)) + 16 + z.b END AS s
            FROM cells a JOIN cells z ON a.idx = z.idx AND a.i < z.i AND a.c = 'e' AND z.c = 'g')
        SELECT idx, s::INT AS score, i || ',' || j AS indices FROM pairs QUALIFY row_number() OVER (PARTITION BY idx ORDER BY s DESC, j DESC, beside, h + i DESC, i) = 1""",
    ),
    "tables_lite": (tables("lite"), "SELECT doc_id AS idx, 0::INT AS score FROM documents WHERE contains(text, 'É')"),
    "tables_compact": (tables("compact"), "SELECT doc_id AS idx, 0::INT AS score FROM documents WHERE contains(text, 'É') OR contains(text, 'é')"),
    "batch_keys": (
        batch_keys,
        """SELECT query, idx, CASE matched_key WHEN 0 THEN 0 ELSE 100 END::INT AS matched_kind, matched_key::INT AS matched_key, row_number() OVER (PARTITION BY query ORDER BY idx) AS rank FROM (
        SELECT '^an' AS query, p_partkey AS idx, CASE WHEN starts_with(lower(p_name), 'an') THEN 0 ELSE 1 END AS matched_key FROM part WHERE starts_with(lower(p_name), 'an') OR starts_with(lower(p_brand), 'an')
        UNION ALL SELECT 'widget$', p_partkey, CASE WHEN ends_with(lower(p_name), 'widget') THEN 0 ELSE 1 END FROM part WHERE ends_with(lower(p_name), 'widget') OR ends_with(lower(p_brand), 'widget')
        UNION ALL SELECT '''brand', p_partkey, CASE WHEN contains(lower(p_name), 'brand') THEN 0 ELSE 1 END FROM part WHERE contains(lower(p_name), 'brand') OR contains(lower(p_brand), 'brand'))""",
    ),
}
