import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankmatch.llm import cws, langid, mixing, packing, simhash
from rankmatch.llm.components import components

from ..conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {x: r for x, r in root.items() if x != r}


def test_few_and_many_edges_have_the_same_components(spark, monkeypatch):
    """Few edges take few jobs; the rounds that many edges take return the same, and keys that are no integers take these rounds."""
    from rankmatch.llm import components as module

    rng = np.random.default_rng(9)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(-150, 150, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(None, 3)], "a bigint, b bigint").persist()
    edges.count()
    spark.sparkContext.setJobGroup("few edges", "")
    few = sorted(components(edges).collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 8
    assert components(edges.where("a is null")).collect() == [] and components(edges).dtypes == [("node", "bigint"), ("root", "bigint")]
    names = components(edges.select(F.format_string("%05d", F.col("a") + 1000).alias("a"), F.format_string("%05d", F.col("b") + 1000).alias("b")).where("a > '00000'"))
    monkeypatch.setattr(module, "TASK_ROWS", 100)
    assert few == sorted(components(edges).collect()) == sorted((int(r["node"]) - 1000, int(r["root"]) - 1000) for r in names.collect())


def test_packing_holds_every_token_once(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.PackConfig().path())
    rows = {(r["doc_id"], r["piece"]): r for r in packing.op4_best_fit_packing(spark, SF).collect()}
    at = {}
    for d in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = packing.cut(len(ids), 1024)
        assert [n for _, n in cuts[1:]] == [1024] * (len(cuts) - 1)
        for i, (start, n) in enumerate(cuts):
            r = rows.pop((d["doc_id"], i))
            assert (r["start"], r["length"], r["ids_crc32"]) == (start, n, zlib.crc32(ids[start : start + n].tobytes()))
            at.setdefault(r["sequence_id"], []).append((r["offset"], n))
    assert not rows
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_added_tokens_in_texts_are_one_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.PackConfig().path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n y", "<|endoftext| >", "it's<|endoftext|>'s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in packing.pieces(df, with_ids=True).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert list(got[0]["ids"]) == [64, 220, 50256, 275, 2]


def test_plans_are_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(30):
        capacity = int(rng.integers(4, 60))
        histogram = {int(n): int(rng.integers(1, 40)) for n in set(rng.integers(1, capacity + 1, 12))}
        slots = packing.plan_slots(histogram, capacity)
        fill, used = {}, {n: set() for n in histogram}
        for n, lo, hi, first, offset, per in sorted(slots, key=lambda s: (-s[0], s[1])):
            for rank in range(lo, hi):
                assert rank not in used[n]
                used[n].add(rank)
                fill.setdefault(first + (rank - lo) // per, []).append((offset + (rank - lo) % per * n, n))
        assert all(used[n] == set(range(c)) for n, c in histogram.items())
        for parts in fill.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
        bins: list[int] = []  # document by document
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            room = min((b for b in bins if b >= n), default=None)
            if room is None:
                bins.append(capacity - n)
            else:
                bins[bins.index(room)] -= n
        assert len(fill) == len(bins)


def test_long_lengths_are_ranked_in_parts(spark):
    cut_up = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    ranks = packing.ranked(cut_up, {7: 500}, packing.PackConfig(rank_rows=20)).select("rank").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(500))


def test_languages_of_texts_held_out(spark, docs):
    got = langid.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    known = langid.train(changed.where(~langid.held_out(F.col("doc_id"))))
    assert "xx" not in known and set(known) == {"de", "en", "es", "fr"}


def test_vectors_are_those_of_their_definition():
    config = langid.LangConfig(dims=64)
    space = langid.Space(config)
    grams, counts, has = langid.grams_of(space, ["Ab, c", "", "ß"])
    vector = counts @ space.vectors(grams)
    letter = {c: space._letter(ord(c) if c != " " else 0).astype(int) for c in " abcß"}
    bind = lambda t: np.roll(letter[t[0]], 2) * np.roll(letter[t[1]], 1) * letter[t[2]]
    assert (vector[0] == sum(bind(t) for t in (" ab", "ab ", "b c", " c "))).all()
    assert (vector[2] == bind(" ß ")).all() and list(has) == [True, False, True]


def plain_simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, docs):
    got = {r["doc_id"]: r for r in simhash.op7_simhash_near_dedup(spark, SF).collect()}
    own = {r["doc_id"]: plain_simhash(r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == own and len(got[0]["fingerprint"]) == 16
    root = {k: k for k in own}
    for _ in own:
        new = {a: min(root[b] for b in own if (own[a] ^ own[b]).bit_count() <= 3) for a in own}
        if new == root:
            break
        root = new
    assert {k: r["component_id"] for k, r in got.items()} == root
    assert simhash.simhash("İ A B x") == plain_simhash("İ A B x") and simhash.simhash(None) == 0
    long = "the a b " * 700
    assert simhash.simhash(long) == plain_simhash(long)


@pytest.mark.parametrize("slice_rows", [4096, 7])
def test_no_link_is_lost(spark, slice_rows):
    """Clouds of near fingerprints, larger than a slice too."""
    rng = np.random.default_rng(8)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for centre in list(prints)[:6]:
        for _ in range(25):
            x = centre
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(simhash.signed(x) for x in prints)
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    got = {r["fp"]: r["class"] for r in simhash.classes(df, simhash.SimHashConfig(slice_rows=slice_rows)).collect()}
    root = {x: x for x in prints}
    near = {x: [y for y in prints if ((x ^ y) & (1 << 64) - 1).bit_count() <= 3] for x in prints}
    for _ in prints:
        new = {x: min(root[y] for y in near[x]) for x in prints}
        if new == root:
            break
        root = new
    assert got == root


def test_mixing_reaches_its_targets(spark):
    rows = [(i, s, f"w{i} " * n) for i, (s, n) in enumerate([("a", 40)] * 3 + [("b", 500)] * 4 + [("c", 9)] * 50 + [(None, 30)] * 20 + [("d", 0)] * 2)]
    df = spark.createDataFrame([(i, s, t.strip()) for i, s, t in rows], "doc_id bigint, source string, text string")
    size = {s: sum(n for q, n in (("a", 120), ("b", 2000), ("c", 450), (None, 600), ("d", 0)) if q == s) for s in ("a", "b", "c", "d", None)}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    total, target, open_ = sum(size.values()), {}, set(size)
    while open_:  # clamp and reshare
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    sized = df.select("doc_id", "source", mixing.n_words("text").alias("__size"))
    plan = sized.select("source", mixing.place(F.col("doc_id"), mixing.MixConfig()).alias("place"), F.col("__size").alias("size"))
    got = mixing.mix(sized, plan).collect()
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["__target"] - target[s]) < 1e-6 for r in own)
        taken = sum(r["__whole"] * r["__size"] + r["__part"] for r in own)
        assert abs(taken - target[s]) < 1 and all(r["__whole"] * r["__size"] + r["__part"] <= 3 * r["__size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(sized.repartition(3), plan).collect()))


def test_gamma_quantiles():
    x = cws._gamma().astype(float)
    assert (np.diff(x) > 0).all() and abs(x.mean() - 2) < 1e-3 and abs(x.var() - 2) < 2e-2


def test_signatures_collide_as_often_as_weights_overlap():
    config = cws.CwsConfig(samples=4000)
    rng = np.random.default_rng(1)
    for _ in range(5):
        words = [f"w{i}" for i in range(40)]
        a, b = (" ".join(w for w, n in zip(words, rng.integers(0, 6, 40)) for _ in range(n)) for _ in "ab")
        x, y = cws.terms_of(a), cws.terms_of(b)
        true = sum(min(x[w], y[w]) for w in x | y) / sum(max(x[w], y[w]) for w in x | y)
        assert abs(cws.likeness(*cws.sketch((a, b), config)) - true) < 4 * np.sqrt(true * (1 - true) / 4000) + 0.005
        assert (cws.sketch((a,), config)[0] == cws.sketch((b, a), config)[1]).all()


def test_edited_texts_and_next_documents(spark, docs):
    import hashlib

    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    got = sorted(cws.op10_document_fingerprints(spark, SF).collect(), key=lambda r: r["doc_id"])
    for i, r in enumerate(got):
        following = texts[(i + 1) % len(texts)]
        e = cws.edited(texts[i], following)
        own, changed, after = (cws.sketch((t,))[0] for t in (texts[i], e, following))
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(texts[i])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (cws.to_hex(own), cws.to_hex(changed))
        assert (r["near_edited"], r["near_next"]) == (cws.likeness(own, changed), cws.likeness(own, after))
    assert cws.edited("abcde", "xyz") == "abcxy" and cws.edited("abcde", "x") == "abcx" and cws.edited("", "x") == ""
