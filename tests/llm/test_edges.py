"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankmatch.llm import cws, langid, licenses, line_dedup, media, mixing, packing, secrets, simhash, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, n bigint, score double, spans string, licenses string, id bigint, row string, band bigint, hash bigint, key string, place string, target double, rank int, length int, fp bigint, secret_spans string, lang_pred string, n_lines int"
LONG = "word soup of many words that go on " * 6000


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "   \n\t\n ", None, "a"),
        (4, LONG, "en", None),
        (5, "Wort und Wort\nLine two of it all", "de", "b"),
        (5, "Wort und Wort\nLine two of it all", "de", "b"),
        (None, "no id here, only text and more text", "en", "b"),
        (7, "ünïcödé 𝄞 text x", None, ""),
        (7, "the same id with another text", "en", "a"),
        (8, "12345 67890 !!!", "en", "c"),
    ]
    filler = (9, 9, 0.5, "s", "l", 1, "r", 1, 2, "k", "p", 1.0, 1, 1, 1, "x", "y", 3)
    return spark.createDataFrame([(i, t, g, s, len(t) if t else None, *filler) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.limit(0)


def by_stage(spark, docs):
    return {name: stage(spark, docs.select(*corpus_pipeline.COLUMNS), "") for name, stage in corpus_pipeline.STAGES}


def operators(docs):
    known = langid.train(docs)
    cut_up = packing.pieces(docs).persist()
    sized = docs.select("source", mixing.place(F.col("doc_id"), mixing.MixConfig()).alias("place"), mixing.n_words("text").alias("size"))
    return {
        "secrets": secrets.scan_secrets(docs),
        "licenses": licenses.scan_licenses(docs),
        "lines": line_dedup.dedup_lines(docs),
        "packing": packing.pack(cut_up),
        "media": media.image_copies(docs, "doc_id", "text", media.page_picture),
        "language": langid.predict(docs, known),
        "simhash": simhash.near_duplicates(docs),
        "passages": substring.passages(docs),
        "mixing": mixing.mix(docs.withColumn("__size", mixing.n_words("text")), sized),
        "fingerprints": cws.fingerprint_edits(docs),
    }


def test_hard_rows(edge):
    found = {name: df.collect() for name, df in operators(edge).items()}
    for name in ("secrets", "licenses", "lines", "language", "simhash", "mixing", "fingerprints", "media"):
        assert len(found[name]) == 10, name
    first = {name: next(r for r in found[name] if (r["img"] if name == "media" else r["doc_id"]) == 1) for name in ("secrets", "lines", "language", "simhash", "mixing", "fingerprints")}
    assert first["secrets"]["secret_spans"] == [] and first["lines"]["text"] == "" and first["language"]["lang_pred"] == "und"
    assert first["simhash"]["fp"] == 0 and first["simhash"]["component_id"] == 1 and first["fingerprints"]["n_chars"] == 0
    empties = [r["component_id"] for r in found["simhash"] if r["doc_id"] in (1, 2, 3)]
    assert empties == [1, 1, 1]
    assert {r["lang_pred"] for r in found["language"] if r["doc_id"] in (2, 3, 8)} == {"und"}
    assert sum(r["length"] for r in found["packing"]) == sum(len(packing.encoder(packing.PackConfig().path()).encode_ordinary(r["text"] or "")) + 1 for r in edge.select("text").collect())
    twice = [r for r in found["lines"] if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_empty_tables(spark, nothing):
    for name, df in operators(nothing).items():
        assert df.collect() == [], name
    for name, df in by_stage(spark, nothing).items():
        assert df.collect() == [], name


def test_stages_on_hard_rows(spark, edge):
    found = by_stage(spark, edge)
    for name, df in list(found.items())[:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS), name
        df.collect()
    kept = {r["doc_id"] for r in found["language_id"].collect()}
    assert {4, 5, None, 7} <= kept and not {1, 2, 3, 8} & kept
    one = [r["doc_id"] for r in found["simhash_near_dedup"].collect()]
    assert one.count(5) == 1 and one.count(1) == 1 and 2 not in one and None in one and one.count(7) == 1


def test_long_ids_beside_null_ids(spark):
    """Ids above 2**53 come out as they went in where another id of the batch is null."""
    ids = [None, 2**53 + 1, 2**53 + 3, 2**53 + 5]
    shared = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(k, f"own{i} text {shared} end{i}") for i, k in enumerate(ids)], "doc_id bigint, text string").coalesce(1)
    key = lambda x: (x is not None, x or 0)
    assert sorted({r["doc_id"] for r in packing.pieces(docs).collect()}, key=key) == ids
    got = cws.fingerprint_edits(docs).collect()
    assert sorted((r["doc_id"] for r in got), key=key) == ids
    found = substring.passages(docs).collect()
    assert sorted({x for r in found for x in (r["doc_id"], r["other_id"])}, key=key) == ids


def test_fingerprints_refuse_other_keys(spark):
    with pytest.raises(TypeError, match="integer key"):
        cws.fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
