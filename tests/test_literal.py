import random

import pytest
from pyspark.sql import functions as F

from rankmatch import Corpus, SearchKey
from rankmatch.functions import kernel
from rankmatch.functions.highlight import highlight_html, html_of
from rankmatch.functions.options import DEFAULT, PATHS, Case, Mode, Preset, Scoring, SearchOptions
from rankmatch.functions.query import parse
from rankmatch.operators.search import match_score

PIECES = ["ab", "aB", "a", "b", "B", "1", "12", " ", "\t", " ", "_", "/", ":", "é", "É", "Ж", "ж", "中", "𝄞", "𐐀", "𐐨", "٣", "x", "ba"]
PRESETS = {"default": DEFAULT, "paths": PATHS, "prefix": Preset(prefer_prefix=True), "lite": Preset(unicode="lite")}


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    return ["", " ", "ab", *("".join(draw.choices(PIECES, k=draw.randint(1, 14))) for _ in range(600))]


@pytest.mark.parametrize("name", PRESETS)
def test_native_scores_equal_the_kernel(spark, texts, name):
    preset = PRESETS[name]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).persist()
    cases = [(q, m) for m in Mode if m != Mode.FUZZY for q in ("ab", "aB", "1", " a", "a ", "é", "ж", "/")]
    cases += [(q, Mode.FUZZY) for q in ("a", "'ab b", "^a 1$", "'a !x", "𝄞")]
    columns = [match_score(F.col("t"), q, m, SearchOptions(), preset).alias(f"c{k}") for k, (q, m) in enumerate(cases)]
    plan = df.select(*columns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    got = [r[1:] for r in sorted(map(tuple, df.select("i", *columns).collect()))]
    hits = 0
    for k, (q, m) in enumerate(cases):
        want = kernel.score_texts(texts, parse(q, m, unicode=preset.unicode), Scoring.FAST, preset).tolist()
        assert [r[k] for r in got] == want, (q, m)
        hits += sum(s > 0 for s in want)
    assert hits > 2000


def test_literal_plans_have_no_python(spark):
    corpus = Corpus.strings(spark, ["red widget", "Red_Widget"])
    for mode in (Mode.PREFIX, Mode.POSTFIX, Mode.EXACT, Mode.SUBSTRING):
        assert "Python" not in corpus.find(mode, "red", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in corpus.many(["red", "wid"], Mode.SUBSTRING)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", [Mode.FUZZY, Mode.SUBSTRING, Mode.POSTFIX])
@pytest.mark.parametrize("scoring", list(Scoring))
def test_many_equals_single_searches_over_all_keys(spark, mode, scoring):
    rows = [("alpha beta", [SearchKey("ab", 2)]), ("gamma", []), ("beta", [SearchKey("alphabet"), SearchKey("ab", 101)]), ("", [SearchKey("abba")])]
    corpus = Corpus.strings(spark, []).add_all([t for t, _ in rows], [k for _, k in rows])
    queries = ["ab", "a", "beta !gam", "zz", "am", ""]
    for limit in (0, 2):
        got = corpus.many(queries, mode, scoring=scoring, limit=limit).collect()
        for q in queries:
            want = corpus.find(mode, q, scoring=scoring, limit=limit).collect()
            mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
            names = ("idx", "score", "matched_kind", "matched_key")
            assert [[r[n] for n in names] for r in mine] == [[r[n] for n in names] for r in want], q
    plan = corpus.many(["ab"], Mode.FUZZY)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("RLIKE")


def test_long_markup(spark):
    draw = random.Random(8)
    rows = [("", []), ("a<b", []), ("&", [0]), ("a𝄞<b&c>", [0, 1, 2, 4, 6])]
    rows += [(t := "".join(draw.choices("ab<>&𝄞", k=n)), sorted(draw.sample(range(n), n // 3))) for n in (3, 50, 30_000)]
    df = spark.createDataFrame(rows, "t string, i array<int>")
    got = [r[0] for r in df.select(highlight_html(F.col("t"), F.col("i"))).collect()]
    assert got == [html_of(t, i) for t, i in rows]


def test_threads_never_make_fewer_partitions(spark):
    corpus = Corpus.strings(spark, list("abc"))
    assert "REPARTITION_BY_NUM" not in corpus.exact("a", threads=2, parallel=True)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in corpus.exact("a", threads=99, parallel=True, case=Case.IGNORE)._jdf.queryExecution().executedPlan().toString()
