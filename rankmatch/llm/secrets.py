"""Secret scan: named patterns plus sliding-window Shannon entropy per character class.

The entropy of a window of ``w`` characters with counts ``c`` is ``log2(w) - sum(c * log2(c)) / w``. The scan slides the
window one character at a time and keeps the counts and the sum, so that a step changes two counts only.
Everything is a Catalyst expression on one row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty

# The contract's patterns.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ORDER = ("assign", "access", "hex", "entropy")
SPANS, CHUNK = "array<struct<start:bigint,stop:bigint,found:string,value:string>>", 128


@dataclass(frozen=True)
class EntropyClass:
    """A candidate belongs to the first class whose ``shape`` it has; a window counts from ``bits`` on."""

    name: str
    shape: str
    bits: float


@dataclass(frozen=True)
class SecretConfig:
    """``allow``: a candidate in which one of these is found is no secret (placeholders, hosts, paths, plain words)."""

    window: int = 20
    alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    candidate: str = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
    classes: tuple[EntropyClass, ...] = (
        EntropyClass("hex", "^([0-9a-f]+|[0-9A-F]+)$", 3.0),
        EntropyClass("letters", "^([a-z]+|[A-Z]+|[A-Z]?[a-z_-]+)$", 4.2),
        EntropyClass("mixed", "^.*$", 3.8),
    )
    allow: tuple[str, ...] = (
        "(?i)example|sample|placeholder|changeme|dummy|your[_-]",
        "(?i)^https?/|^www-|/.*/.*/",
        "^[0-9]+$",
        "(.)\\1{5,}",
        "(?i)abcdefghij|0123456789",
        "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    )


def located(text: Column, pattern: str, group: int | None = None) -> Column:
    """``array<struct<start,stop,found,value>>`` of the leftmost non-overlapping matches, in code points.

    Between the matches lie what ``split`` returns, so starts are running sums of lengths. They are summed a chunk at a time, so
    that what is appended to stays small however many matches a text has.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(found.alias("found"), value.alias("value"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("before"))
    none = f"cast(array() AS {SPANS})"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        stop = start + F.length(x["found"])
        return F.struct(stop.alias("at"), F.array_append(state["spans"], F.struct(start.alias("start"), stop.alias("stop"), x["found"].alias("found"), x["value"].alias("value"))).alias("spans"))

    def chunk(done: Column, all_parts: Column, k: Column) -> Column:
        zero = F.struct(F.element_at(done, -1)["at"].alias("at"), F.expr(none).alias("spans"))
        return F.array_append(done, F.aggregate(F.slice(all_parts, k * CHUNK + 1, CHUNK), zero, step))

    def every(p: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.expr(f"array(struct(0L AS at, {none} AS spans))"), lambda done, k: chunk(done, p, k), lambda done: F.flatten(F.transform(done, lambda c: c["spans"])))

    return F.when(text.rlike(pattern), F.get(F.transform(F.array(parts), every), F.lit(0))).otherwise(F.expr(none))


def of_kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER.index(kind)).alias("rank"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _runs(found: Column, config: SecretConfig) -> Column:
    """Maximal ``[from, to)`` ranges of the candidate covered by windows that reach their class's bits."""
    w = config.window
    codes = F.transform(F.split(found, ""), lambda c: F.instr(F.lit(config.alphabet), c).cast("int"))
    need = F.coalesce(*(F.when(found.rlike(k.shape), F.lit(k.bits)) for k in config.classes))

    def clog(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def step(s: Column, i: Column) -> Column:
        add = F.element_at(s["codes"], i)
        gone = F.when(i > w, F.element_at(s["codes"], i - w)).otherwise(F.lit(0))
        up, down = F.element_at(s["counts"], add), F.when(gone > 0, F.element_at(s["counts"], F.greatest(gone, F.lit(1)))).otherwise(F.lit(0))
        same = add == gone
        total = F.when(same, s["total"]).otherwise(s["total"] + clog(up + 1) - clog(up) + F.when(gone > 0, clog(down - 1) - clog(down)).otherwise(F.lit(0.0)))
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + F.when(k + 1 == add, F.lit(1)).when(k + 1 == gone, F.lit(-1)).otherwise(F.lit(0))))
        high = (i >= w) & (F.log2(F.lit(float(w))) - total / w >= s["need"] - 1e-9)
        last = F.try_element_at(s["runs"], F.lit(-1))
        joins = F.coalesce(last["to"] >= i - w, F.lit(False))
        before = F.when(joins, F.slice(s["runs"], F.lit(1), F.greatest(F.size(s["runs"]) - 1, F.lit(0)))).otherwise(s["runs"])
        run = F.struct(F.when(joins, last["from"]).otherwise(i - w).cast("int").alias("from"), i.cast("int").alias("to"))
        return F.struct(s["codes"].alias("codes"), counts.alias("counts"), total.alias("total"), s["need"].alias("need"), F.when(high, F.array_append(before, run)).otherwise(s["runs"]).alias("runs"))

    start = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(config.alphabet)).alias("counts"), F.lit(0.0).alias("total"), need.alias("need"), F.expr("cast(array() AS array<struct<from:int,to:int>>)").alias("runs"))
    return F.aggregate(F.sequence(F.lit(1), F.length(found)), start, step, lambda s: s["runs"])


def entropy_spans(text: Column, config: SecretConfig) -> Column:
    allowed = "|".join(f"(?:{p})" if "\\1" not in p else p for p in sorted(config.allow, key=lambda p: "\\1" not in p))
    candidates = F.filter(located(text, config.candidate), lambda x: ~x["found"].rlike(allowed))
    return F.flatten(F.transform(candidates, lambda x: F.transform(_runs(x["found"], config), lambda r: F.struct((x["start"] + r["from"]).alias("start"), (x["start"] + r["to"]).alias("stop")))))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan_secrets(df: DataFrame, text: str = "text", config: SecretConfig = SecretConfig()) -> DataFrame:
    """``df`` with ``base_spans`` and ``secret_spans``: ``array<struct<start,rank,stop,kind>>`` by start, then kind.

    Null and empty texts have empty arrays; repeated rows keep their own; columns of these two names are replaced.
    Entropy spans inside a span of a named pattern add nothing and are left out. Texts of any length are read whole.
    """
    t = text_or_empty(text)
    assign = F.filter(located(t, ASSIGN, 2), lambda x: F.length(x["value"]) >= 8)
    access = F.filter(located(t, ACCESS), lambda x: F.length(x["found"]) >= 16)
    hexes = located(t, "(?<![0-9a-f])[0-9a-f]{32,}")  # a maximal run, as the plain pattern finds it
    base = F.array_sort(F.concat(of_kind(assign, "assign"), of_kind(access, "access"), of_kind(hexes, "hex")))
    out = df.withColumn("base_spans", base).withColumn("__entropy", entropy_spans(t, config))
    extra = F.filter(F.col("__entropy"), lambda e: ~F.exists(F.col("base_spans"), lambda b: (b["start"] <= e["start"]) & (e["stop"] <= b["stop"])))
    return out.withColumn("secret_spans", F.when(F.size("__entropy") == 0, F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", of_kind(extra, "entropy"))))).drop("__entropy")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(F.col("base_spans")), 256).alias("base_sha256"), digest(F.col("secret_spans")).alias("spans"))


def op1_sql(config: SecretConfig = SecretConfig()) -> str:
    """The same rows in DuckDB: positions by cumulated lengths, entropy by its own aggregate over every window."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    w = config.window
    run = config.candidate.partition(")")[2]
    need = "CASE " + " ".join(f"WHEN regexp_matches(found, {quote(k.shape)}) THEN {k.bits}" for k in config.classes) + " END"
    repeated = "list_bool_or([contains(found, repeat(c, 6)) FOR c IN string_split(found, '')])"  # RE2 has no back-references
    allowed = " OR ".join(repeated if "\\1" in p else f"regexp_matches(found, {quote(p)})" for p in config.allow)

    def spans(name: str, rank: int, pattern: str, keep: str, group: int = 0) -> str:
        return f"""SELECT row, start, {rank} AS rank, stop, '{name}' AS kind, found FROM (
            SELECT row, found, value, (sum(length(before) + length(found)) OVER (PARTITION BY row ORDER BY i))::BIGINT AS stop, stop - length(found) AS start FROM (
                SELECT row, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS found, unnest(v) AS value, unnest(p[1:len(m)]) AS before FROM (
                    SELECT row, regexp_extract_all(t, {quote(pattern)}) AS m, regexp_extract_all(t, {quote(pattern)}, {group}) AS v, string_split_regex(t, {quote(pattern)}) AS p FROM d WHERE regexp_matches(t, {quote(pattern)})))) WHERE {keep}"""

    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({spans("assign", 0, ASSIGN.replace("(?i:(", "(?i:(").replace("\\x20", " "), "length(value) >= 8", 2)} UNION ALL {spans("access", 1, ACCESS, "length(found) >= 16")} UNION ALL {spans("hex", 2, HEX, "length(found) >= 32")}),
    cand AS (SELECT row, start, found, {need} AS need FROM ({spans("entropy", 3, run, "true")}) WHERE NOT ({allowed})),
    high AS (SELECT row, start AS c, i, i + {w} AS j FROM (SELECT *, unnest(range(0, length(found) - {w} + 1)) AS i FROM cand) WHERE list_aggregate(string_split(substr(found, i::INT + 1, {w}), ''), 'entropy') >= need - 1e-9),
    island AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev < i THEN 1 ELSE 0 END) OVER (PARTITION BY row, c ORDER BY i) AS g FROM (SELECT *, lag(j) OVER (PARTITION BY row, c ORDER BY i) AS prev FROM high)),
    extra AS (SELECT row, c + min(i) AS start, 3 AS rank, c + max(j) AS stop, 'entropy' AS kind FROM island GROUP BY row, c, g),
    every AS (SELECT row, start, rank, stop, kind FROM base UNION ALL SELECT * FROM extra e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = e.row AND b.start <= e.start AND e.stop <= b.stop)),
    joined AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM every GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN joined USING (row)"""
