import pytest
from pyspark.sql import functions as F

from rankmatch import ClosedCorpusError, Corpus, KeyKind, Mode, Scoring, SearchKey, build_async, match_indices, match_score
from rankmatch.functions.highlight import highlight_html, to_utf16
from rankmatch.plans.more import greedy
from rankmatch.streaming.search import stream_search

NAMES = ["configure", "cfg_helper", "my_cfg", "xyz_config", "no_match_xyz"]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.strings(spark, NAMES)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_order_limit_and_scores(corpus):
    assert rows(corpus.fuzzy("cfg"), "idx", "score") == [(1, 72), (2, 72), (0, 57), (3, 57)]
    assert rows(corpus.fuzzy("cfg", limit=2), "idx") == [(1,), (2,)]
    assert rows(corpus.fuzzy("cfg", scoring=Scoring.OFF, limit=2), "idx", "score") == [(0, 0), (1, 0)]
    assert rows(corpus.fuzzy(""), "idx", "score") == [(i, 0) for i in range(5)]
    assert rows(corpus.fuzzy("!c"), "idx") == []  # every name has one
    assert rows(corpus.fuzzy("!g"), "idx", "score") == [(4, 0)]


def test_partitions_change_nothing(spark):
    many = Corpus.strings(spark, [f"file_{i}_widget_{7 * i % 13}.dart" for i in range(400)])
    for query in ("widget", "fwd", "file5", "z", ".dart"):
        for limit in (0, 1, 10):
            assert many.fuzzy(query, limit=limit).collect() == many.fuzzy(query, limit=limit, threads=5, parallel=True).collect()


def test_plans(corpus):
    """The native filter is below the score, which is worked out once; the order is cut by TakeOrderedAndProject."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(corpus.fuzzy("cfg", limit=2))
    assert p.count("ArrowEvalPython") == 1 and "TakeOrderedAndProject" in p
    assert p.index("ArrowEvalPython") < p.rindex("RLIKE")
    p = plan(corpus.fuzzy("cfg", limit=2, highlight=True))
    assert "TakeOrderedAndProject" in p and "MapInPandas" in p
    assert "Python" not in plan(corpus.exact("cfg", scoring="off")) and "Arrow" not in plan(corpus.exact("cfg", scoring="off"))
    p = plan(corpus.many(["a", "b"], limit=3))
    assert "WindowGroupLimit" in p


def test_scores_are_not_worked_out_in_one_task_or_twice(spark, sf_dir):
    """Long texts are made where their keys were dealt to, and a sort, which reads its input twice, reads scores from a shuffle."""
    for scoring in (Scoring.FAST, Scoring.NUCLEO):
        hits = greedy(spark, sf_dir, scoring)
        p = hits._jdf.queryExecution().executedPlan().toString()
        assert p.index("rangepartitioning") < p.index("hashpartitioning") < p.index("ArrowEvalPython") < p.index("RLIKE") and "FileScan" not in p
        assert hits.count() == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


def test_highlights(corpus):
    hits = corpus.fuzzy("cfg", highlight=True, limit=3).collect()
    assert hits[0]["indices"] == [0, 1, 2] and corpus.fuzzy("cfg").first()["indices"] == []
    assert corpus.fuzzy("cfg", highlight=True).collect()[0]["indices"] == [0, 1, 2]
    text = corpus.items.sparkSession.createDataFrame([("a𝄞b<c", [0, 1, 3])], "t string, i array<int>")
    got = text.select(to_utf16(F.col("t"), F.col("i")).alias("u"), highlight_html(F.col("t"), F.col("i")).alias("h")).first()
    assert got["u"] == [0, 1, 4] and got["h"] == "<mark>a𝄞</mark>b<mark>&lt;</mark>c"


def test_keys(spark):
    c = Corpus.strings(spark, []).add_key("张三", [SearchKey("zhangsan"), SearchKey("zs", KeyKind.INITIALS)])
    c = c.add_key("李四", [SearchKey("lisi"), SearchKey("ls", KeyKind.INITIALS)]).add("Zachary")
    assert rows(c.fuzzy("zhangsan"), "idx", "matched_kind", "matched_key") == [(0, 1, 1)]
    assert rows(c.fuzzy("zs"), "idx", "matched_kind")[0] == (0, 2)
    assert rows(c.fuzzy("张", highlight=True), "idx", "matched_kind", "indices") == [(0, 0, [0])]
    assert rows(c.update(0, "plain").fuzzy("zhangsan"), "idx") == []
    made = Corpus.strings(spark, ["abc", "xyz"]).with_keys(lambda t: [(KeyKind.ROMAJI, F.reverse(t))])
    assert rows(made.exact("cba"), "idx", "matched_kind") == [(0, 3)]


def test_fields(spark):
    df = spark.createDataFrame([(0, "Acme Inc", "Boston", ("p1",)), (1, "Globex", "Acme City", ("p2",)), (2, None, None, None)], "i int, name string, city string, platform struct<id:string>")
    both = Corpus.by_keys(df, ["name", "city"], idx=F.col("i"))
    assert rows(both.fuzzy("acme"), "idx", "matched_kind", "matched_key") == [(0, 0, 0), (1, 100, 1)]
    assert rows(Corpus.by_key(df, "platform.id", idx=F.col("i")).exact("p2"), "idx") == [(1,)]
    assert rows(Corpus.by_key(df, "name", idx=F.col("i")).fuzzy(""), "idx", "score") == [(0, 0), (1, 0), (2, 0)]
    assert both.fuzzy_raws("globex").first()["city"] == "Acme City"
    with pytest.raises(ValueError):
        Corpus.by_keys(df, [])
    with pytest.raises(ValueError):
        Corpus.by_key(df, "name")


def test_changes(spark):
    c = Corpus.strings(spark, ["remove_me", "keep_this", "also_remove", "keep_that"])
    kept, gone = c.remove_where(F.col("text").contains("remove"))
    assert gone == 2 and rows(kept.items.orderBy("idx"), "idx", "text") == [(0, "keep_this"), (1, "keep_that")]
    assert rows(c.remove_at(1).items.orderBy("idx"), "idx", "text") == [(0, "remove_me"), (1, "also_remove"), (2, "keep_that")]
    assert c.add_all(["x", "y"]).length() == 6 and c.append(kept).length() == 6
    assert rows(c.update(2, "new").items.where("idx = 2"), "text") == [("new",)]
    assert c.clear().length() == 0 and c.clear().add("z").fuzzy("z").first()["idx"] == 0
    assert c.refresh(F.upper("raw.value")).prefix("KEEP").count() == 2 and c.refresh(source=kept).length() == 2
    with pytest.raises(IndexError):
        c.remove_at(4)


def test_life(spark):
    with Corpus.strings(spark, NAMES).persist() as c:
        futures = [c.fuzzy_async("cfg", limit=1), c.exact_async("my_cfg"), c.suffix_raws_async("cfg")]
        assert [len(f.result()) for f in futures] == [1, 1, 1]
        assert c.one.fuzzy("cfg")["idx"] == 1 and c.one.exact("nothing") is None and c.one.raw(Mode.PREFIX, "my")["value"] == "my_cfg"
        assert c.one.suffix_raw("cfg")["value"] == "my_cfg" and c.one.fuzzy_async("cfg").result()["idx"] == 1 and c.one.exact_raw_async("x").result() is None
        assert c.add_all_async(["new"]).result().length() == 6 and c.length() == 5
    c.close()
    with pytest.raises(ClosedCorpusError):
        c.fuzzy("cfg")
    assert build_async(lambda: Corpus.strings(spark, NAMES)).result().length() == 5


def test_many_queries_equal_single_ones(corpus):
    got = corpus.many(["cfg", "no", "zzz"], limit=2)
    for q in ("cfg", "no", "zzz"):
        assert rows(got.where(F.col("query") == q).orderBy("rank"), "idx", "score") == rows(corpus.fuzzy(q, limit=2), "idx", "score")


def test_columns_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("cfg_helper",), ("zzz",), (None,)], "name string")
    got = df.select(match_score(F.col("name"), "cfg").alias("s"), match_indices(F.col("name"), "cfg").alias("i")).collect()
    assert [r["s"] for r in got] == [72, -1, -1] and got[0]["i"] == [0, 1, 2] and got[1]["i"] == []
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_search(spark.readStream.schema("name string").parquet(str(tmp_path / "in")), F.col("name"), "cfg")
    q = stream.writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from hits").collect()] == [("cfg_helper", 72)]
