"""Vector operators against brute force, components, and the pipeline stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeline.llm import embed_dedup, language, mixing, neighbours
from gradeline.llm.common import components
from test_text_operators import brute_classes, brute_components

VECTORS = "vec_id long, embedding array<float>, label int, key string, w int"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "k", 1) for i, v in vectors]
    return spark.createDataFrame(rows, VECTORS)


def clusters(seed, n=240, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n // 12):
        centre = rng.normal(size=dim)
        for k in range(12):
            out.append(centre + rng.normal(size=dim) * rng.choice([0.0, 0.2, 0.35, 0.5, 3.0]))
    return [(int(i), v.astype(np.float32)) for i, v in enumerate(out)]


ODD = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [float("inf")] + [1.0] * 23),
       (1004, [None] + [1.0] * 23), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]


@pytest.mark.parametrize("block", [1500, 5])
def test_near_vectors_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    vectors = clusters(1)
    out = {r.vec_id: r for r in embed_dedup.near_duplicates(frame(spark, vectors + ODD + [vectors[0]])).collect()}
    x = np.array([v for _, v in vectors], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    again = vectors[0][1]
    for i, _ in vectors:
        linked = {j for j in range(len(x)) if j != i and cos[i, j] >= 0.9}
        twice = 1 if (vectors[i][1] == again).all() or (0 in linked) else 0
        assert out[i].n_links == len(linked) + twice
    want = brute_components(range(len(x)), lambda a, b: cos[a, b] >= 0.9)
    assert all(out[i].component_id == want[i] and out[i].kept == (want[i] == i) for i in want)
    assert all(out[i].n_links == 0 and out[i].kept for i in range(1000, 1006))
    assert out[1007].component_id == 1006 and out[1006].n_links == 1


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    only = frame(spark, ODD[:5])
    assert {r.n_links for r in embed_dedup.near_duplicates(only).collect()} == {0}
    assert neighbours.nearest(only, F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(1500, 24)) * rng.choice([0.5, 1, 2], size=(1500, 1))).astype(np.float32)
    x[700] = x[701] = x[20]
    out = neighbours.nearest(frame(spark, list(enumerate(x)) + ODD), F.col("vec_id") % 20 == 0, k=20).collect()
    y = x.astype(np.float64)
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        assert abs(r.score - y[r.query_id] @ y[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    hit = 0
    for q in range(0, 1500, 20):
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        s = y @ y[q]
        s[q] = -np.inf
        hit += len({r[2] for r in rows} & set(np.argsort(-s)[:20].tolist()))
    assert hit / (75 * 20) >= 0.9 and set(got) == set(range(0, 1500, 20))


def test_few_candidates_are_all_returned(spark):
    rng = np.random.default_rng(4)
    out = neighbours.nearest(frame(spark, list(enumerate(rng.normal(size=(7, 24))))), F.col("vec_id") % 20 == 0, k=20)
    assert [(r.query_id, r["rank"]) for r in out.orderBy("rank").collect()] == [(0, i) for i in range(1, 7)]


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (400, neighbours.TABLES), dtype=np.uint16)
    asked = codes[:20].copy()
    asked[:, ::2] ^= 5
    for radius in (0, 3, 20, 40, 100, 130):
        q, row = neighbours.probe(codes, asked, radius)
        apart = np.bitwise_count(asked[:, None, :] ^ codes).sum(axis=2)
        assert sorted(zip(q.tolist(), row.tolist())) == sorted(zip(*(a.tolist() for a in np.nonzero(apart <= radius))))


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x[2000:] = x[:2000] + rng.normal(size=(2000, 64)) * 0.45
    x /= np.linalg.norm(x, axis=1)[:, None]
    signs, turned, factor = embed_dedup.codes(x)
    i, j = np.arange(2000), np.arange(2000, 4000)
    guess = np.einsum("ij,ij->i", signs[i], turned[j]) / (8 * factor[i])
    true = np.einsum("ij,ij->i", x[i], x[j])
    assert abs((guess - true).mean()) < 0.01
    near = true >= 0.9
    assert near.sum() > 500 and embed_dedup.estimated(i[near], j[near], signs, turned, factor, 0.9).all()


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (7, -4)]
    links += [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    pairs = {frozenset(x) for x in links}
    ids = sorted({i for x in links for i in x})
    want = brute_components(ids, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {i: want[i] for i in got} and set(got) == {i for x in links if x[0] != x[1] for i in x}
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


# -- pipeline -------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["language", "near_duplicates", "secrets", "mixing", "packing"]

    kept = stage["language"](spark, docs, sf)
    told = language.identify(docs, language.fit(docs)).where("lang_pred <> 'und' AND score >= 0.4")
    assert kept.columns == columns and kept.count() == told.count() > 0

    one = stage["near_duplicates"](spark, kept, sf)
    want = brute_classes([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in want.values()})

    clean = stage["secrets"](spark, one, sf)
    assert clean.columns == columns and clean.count() == one.count()
    assert all(r.n_chars == len(r.text) for r in clean.where(F.col("text").contains("[SECRET]")).collect())

    some = stage["mixing"](spark, clean, sf)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert some.columns == columns
    assert {r.doc_id: r["count"] for r in some.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}

    packed = stage["packing"](spark, some, sf)
    per = packed.where("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in per} == {k: v for k, v in copies.items() if v}
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_documents_stay_when_no_language_is_known(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.one_language(spark, docs, "")
    want = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert out.columns == docs.columns and len(want) > 10
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect())


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        path = f"{tmp_path}/{name}"
        docs.write.parquet(f"{path}/documents.parquet")
        out = corpus_pipeline.run(spark, path)
        assert "sequence_id" in out.columns and (out.count() > 0) == (name == "odd")
