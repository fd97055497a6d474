"""Language mixtures against plain loops, bounded memory and sample bounds."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import language


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    table = rng.dirichlet(np.full(language.BUCKETS, 0.02), 3).T + 1e-7
    return language.LanguageModel(["aa", "bb", "cc"], np.log(table / table.sum(axis=0)).astype(np.float32))


def sayings(model, seed, weights, n=120):
    """Words each of which is the likeliest of 40 random ones under a drawn language."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.choices(range(len(weights)), weights)[0]
        tries = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(40)]
        score = [model.log_prob[language.trigrams(w.encode())[0]].sum(axis=0) for w in tries]
        out.append(tries[int(np.argmax([s[k] - max(s[j] for j in range(len(s)) if j != k) for s in score]))])
    return " ".join(out).encode()


def plain(model, text, chosen, rounds=6):
    """EM over the chosen languages, one word at a time: proportions and log likelihood."""
    words = [model.log_prob[language.trigrams(w)[0]].astype(float).sum(axis=0) for w in text.split()]
    like = [[math.exp(max(x - max(w), -60.0)) for x in w] for w in words]
    share = {k: 1 / len(chosen) for k in chosen}
    for _ in range(rounds):
        new = dict.fromkeys(chosen, 0.0)
        for w in like:
            total = max(sum(share[k] * w[k] for k in chosen), 1e-300)
            for k in chosen:
                new[k] += share[k] * w[k] / total / len(like)
        share = new
    return share, sum(math.log(max(sum(share[k] * w[k] for k in chosen), 1e-300)) for w in like)


@pytest.mark.parametrize("weights", [(1, 0, 0), (0, 1, 1), (3, 1, 0), (1, 1, 1)])
def test_mixtures_equal_plain_em_over_all_subsets(model, weights):
    text = sayings(model, 5, weights)
    found = []
    for size in (1, 2, 3):
        for chosen in itertools.combinations(range(3), size):
            share, value = plain(model, text, chosen)
            found.append((value - 2.0 * size * math.log(len(text.split())), share))
    best = max(found, key=lambda x: x[0])[1]
    got = model.mixtures([b"", text, b"12 !"])
    assert not got[0].any() and not got[2].any()
    assert {k for k in range(3) if got[1][k] > 0} == set(best)
    assert np.allclose([best.get(k, 0.0) for k in range(3)], got[1], atol=1e-4)


def test_chunks_do_not_change_results(model, monkeypatch):
    texts = [sayings(model, i, w, n) for i, (w, n) in enumerate([((1, 1, 0), 900), ((0, 0, 1), 5), ((1, 2, 3), 2500), ((1, 0, 0), 40)])]
    whole = model.mixtures(texts)
    monkeypatch.setattr(language, "SLICE", 1 << 12)
    monkeypatch.setattr(language, "KEPT", 20_000)
    assert len(model.chunks(texts)) > 2
    assert np.allclose(whole, model.mixtures(texts), atol=1e-6)


def test_memory_does_not_follow_words_times_languages(monkeypatch):
    """Two million bytes of words in 40 languages: likelihoods in double precision would be 140 MB."""
    rng = np.random.default_rng(1)
    model = language.LanguageModel([f"l{i:02}" for i in range(40)], rng.normal(-10, 1, (language.BUCKETS, 40)).astype(np.float32))
    monkeypatch.setattr(language, "KEPT", 8 << 20)
    text = b"wort und satz " * 150_000
    tracemalloc.start()
    share = model.mixtures([text], rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert share.sum() == pytest.approx(1) and peak < 120 << 20


def test_many_languages_and_no_blanks():
    rng = np.random.default_rng(2)
    table = rng.dirichlet(np.full(language.BUCKETS, 0.02), 200).T + 1e-7
    model = language.LanguageModel([f"l{i:03}" for i in range(200)], np.log(table / table.sum(axis=0)).astype(np.float32))
    got = model.mixtures([sayings(model, 7, [0] * 150 + [1] + [0] * 49, 60), b"x" * 500_000])
    assert got[0].argmax() == 150 and got.sum(axis=1) == pytest.approx(1)


def test_the_sample_is_cut_by_histograms(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 100 == 7, "rare").otherwise("hot").alias("lang"), F.xxhash64("id").alias("_h"))
    cuts = language.hash_cuts(rows, "lang", 500)
    assert set(cuts) == {"hot"}
    hot = sorted(r._h for r in rows.where("lang = 'hot'").collect())
    assert sum(h <= cuts["hot"] for h in hot) == 500 and cuts["hot"] >= hot[499]
    assert language.hash_cuts(rows.limit(0), "lang", 5) == {}


def test_rows_without_an_id_are_sampled_by_text(spark):
    rows = [(None, f"word{i} alpha", "en") for i in range(300)] + [(i, f"mot{i} beta", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = docs.select("lang", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).alias("_h"))
    cut = language.hash_cuts(held, "lang", 100)
    assert held.where("lang = 'en'").where(F.col("_h") <= cut["en"]).count() == 100
    assert language.fit(docs, per_language=100).languages == ["en", "fr"]
