"""Ids that stand for several texts, and rows without an id: nothing is lost or taken all or none."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import embed_dedup, minhash, mixing, neighbours, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(10**6)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)


def test_repeats_of_another_text_with_the_same_id(spark):
    a, b = prose(1), prose(2)
    df = frame(spark, [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, b, "s"), (2, a, "s"), (None, a, "s")])
    got = sorted((r.doc_id or 0, r.kept_text, r.n_removed) for r in substring.remove_repeats(df).collect())
    kept = [t for _, t, _ in got]
    assert len(got) == 6 and kept.count(a) == 2 and kept.count(b) == 1
    assert (1, a, 0) in got and (0, a, 0) in got and got.count((2, "", 40)) >= 2


def test_links_of_every_text_of_an_id(spark):
    a, b, c = prose(1), prose(2), prose(3)
    near_a, near_b = a.rsplit(" ", 1)[0], b.rsplit(" ", 1)[0]
    rows = [(5, a, "s"), (2, a + " x", "s"), (2, b, "s"), (7, near_b, "s"), (9, near_a, "s"), (4, c, "s"), (4, prose(4), "s"), (4, c, "s")]
    df = frame(spark, rows)
    got = {(r.doc_id, r.component_id) for r in minhash.duplicate_classes(df, width=4).collect()}
    assert got == {(5, 2), (2, 2), (7, 2), (9, 2), (4, 4)}


def test_the_pipeline_keeps_texts_that_share_an_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b = prose(1), prose(2)
    rows = [(2, a, "s"), (2, b, "s"), (2, b, "s"), (3, b + " tail", "s"), (None, a, "s")]
    out = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "")
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    left = sorted((r.doc_id or 0, r.text) for r in out.collect())
    # Of the near copies (2, b) and (3, b tail) one stays.
    assert (2, a) in left and (0, a) in left and len(left) == 3


def test_mixing_splits_rows_without_an_id(spark):
    rows = [(None, prose(i, 10), "a") for i in range(200)] + [(i, prose(1000 + i, 10), "b") for i in range(200)]
    got = mixing.mix(frame(spark, rows)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 2
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 10


VECTORS = "vec_id long, embedding array<float>, score double, id long, key string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 9, "k", 3) for i, v in rows], VECTORS)


def test_every_vector_of_an_id_keeps_its_links(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, x), (2, x), (2, y), (7, [0.0, 1.0, 0.05]), (9, [1.0, 0.05, 0.0]), (4, z), (2, x), (None, x), (2, None), (3, None)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embed_dedup.near_duplicates(vectors(spark, rows)).collect())
    assert got == [
        (0, 0, 0, True), (2, 0, 2, True), (2, 1, 2, True), (2, 3, 2, True), (2, 3, 2, True), (3, 0, 3, True),
        (4, 0, 4, True), (5, 3, 2, False), (7, 1, 2, False), (9, 3, 2, False),
    ]


def test_every_vector_of_an_id_is_a_candidate(spark):
    rows = [(20, [1.0, 0.0]), (5, [0.5, 0.0]), (5, [0.9, 0.0]), (5, [0.9, 0.0]), (3, [0.5, 0.1]), (None, [9.0, 0.0]), (7, None), (20, [0.0, 0.0])]
    out = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 3)) for r in out.orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 5, 0.9), (20, 2, 3, 0.5), (20, 3, 5, 0.5)]


def test_keys_grow_with_the_table():
    same = 1 - np.arccos(0.9) / np.pi
    last = (0, 0)
    for n in (0, 1, 1000, 60_000, 10**6, 10**9):
        bits, tables = embed_dedup.keying(n)
        assert n / 2**bits <= embed_dedup.CROWD and (1 - same**bits) ** tables <= 6.2e-5 and (bits, tables) >= last
        last = bits, tables
    assert embed_dedup.keying(60_000) == (14, 80)


def test_longer_keys_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        rows += [(c * 10 + i, (centre + rng.normal(size=16) * 0.25).astype(np.float32).tolist()) for i in range(6)]
    df = vectors(spark, rows)
    plain = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embed_dedup, "keying", lambda n: (18, 158))
    monkeypatch.setattr(embed_dedup, "HELD", 5000)
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == plain
