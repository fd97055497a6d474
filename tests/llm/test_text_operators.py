"""Edge cases and brute-force versions of the operators on documents."""

import array
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import language, minhash, mixing, packing, quality, secrets, substring, tokens
from gradeline.llm.queries import word_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *by):
    return sorted((tuple(r[c] for c in (by or df.columns)) for r in df.collect()), key=str)


# -- tokens and packing -------------------------------------------------------------------------

def random_text(rng):
    pool = "abcdeXYZ012'.,!-|$ \t\n\x0b\x1c\x85\xa0 \xe9\xc9\xdf\xd8\xd7\xf7İΣσ中가̀\U0001f600ﬁ½"
    special = ["<|endoftext|>", "<|startoftext|>", "'s", "don't", "<|end", "thereof", "Nation"]
    return "".join(rng.choice(special) if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 40)))


def test_counts_and_ids_equal_the_library():
    from tokenizers import Tokenizer

    path, rng = word_vocabulary(), random.Random(2)
    library, counter, ids = Tokenizer.from_file(path), tokens.WordVocabulary(path, limit=50), packing.WordIds(path, limit=50)
    for _ in range(3000):
        text = random_text(rng)
        want = library.encode(text, add_special_tokens=False).ids
        assert counter.count(text.encode()) == len(want), repr(text)
        assert list(array.array("I", ids.encode(text.encode()))) == want, repr(text)


def test_merging_takes_the_lowest_rank_then_the_leftmost():
    # a=1 b=2 aa=3 ab=4; "aa" before "ab": a a a b -> aa ab
    assert tokens.merged_length([1, 1, 1, 2], {1 << 20 | 1: 0, 1 << 20 | 2: 1}, [3, 4]) == 2
    assert tokens.merged_length([1, 1, 1, 2], {1 << 20 | 1: 1, 1 << 20 | 2: 0}, [4, 3]) == 2
    assert tokens.merged_length([1], {}, []) == 1


def test_other_vocabularies_are_refused():
    import public_tokenizers

    for kind in (tokens.WordVocabulary, packing.WordIds):
        with pytest.raises(ValueError):
            kind(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    out = tokens.with_token_counts(odd_docs, word_vocabulary())
    assert set(odd_docs.columns) < set(out.columns)
    for r in out.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 2048)
    assert tokens.with_token_counts(no_docs, word_vocabulary()).count() == 0


def test_open_bins_against_plain_best_fit():
    rng = random.Random(8)
    bins, free, closed = packing.OpenBins(50, 4), {}, []
    for _ in range(3000):
        size = rng.randint(1, 50)
        fits = [f for f in free.values() if f >= size]
        number, offset = bins.place(size)
        if fits:
            assert free[number] == min(fits) and offset == 50 - free[number]
        else:
            if len(free) == 4:
                fullest = min(free.values())
                assert bins.open <= 4
                gone = [k for k in free if k not in {b for s in bins.stacks for b in s}]
                assert len(gone) == 1 and free[gone[0]] == fullest
                closed.append(gone[0])
                del free[gone[0]]
            assert number not in closed and offset == 0
            free[number] = 50
        free[number] -= size
        if not free[number]:
            del free[number]


def test_packing_is_gapless_and_whole(odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary())
    capacity = 256
    out = packing.pack_documents(odd_docs, word_vocabulary(), capacity).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= 1.1 * sum(r.length for r in out) / capacity + 1
    assert rows(packing.pack_documents(odd_docs, word_vocabulary(), capacity)) == sorted(map(tuple, out), key=str)
    assert packing.pack_documents(no_docs, word_vocabulary()).count() == 0


# -- mixing --------------------------------------------------------------------------------------

def reshared(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[n] for n in free)
        add, left = {n: left * weight[n] / total for n in free}, 0.0
        for n in list(free):
            target[n] += add[n]
            if target[n] >= most * sizes[n]:
                left += target[n] - most * sizes[n]
                target[n] = most * sizes[n]
                free.discard(n)
    return target


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(6)
    for _ in range(5):
        sizes = {f"s{i}": rng.choice([0, 1, 7, 50, 400, 9000]) for i in range(9)} | {None: 30, "": 5}
        df = spark.createDataFrame([(k is None, k or "", v) for k, v in sizes.items()], "_none boolean, _source string, size long")
        got = {None if r._none else r._source: r.target for r in mixing.targets(df).collect()}
        want = reshared(sizes)
        assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes), (got, want)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    docs = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    want, sizes, taken = {}, Counter(), Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        want[r.source] = r.target
    exact = reshared(sizes)
    assert all(abs(want[k] - exact[k]) < 1e-6 and abs(taken[k] - want[k]) <= 20 for k in sizes)
    again = mixing.resample(df).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r.copies for r in out}
    assert {r.doc_id: r["count"] for r in again} == {k: v for k, v in copies.items() if v}


def test_mix_edges(odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    for r in out.join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        assert r.size == len(WORD.findall(r.text or ""))
    assert out.count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0 and mixing.resample(no_docs).count() == 0
    assert mixing.resample(odd_docs).columns == odd_docs.columns


# -- near duplicates ------------------------------------------------------------------------------

def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute_classes(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs if d is not None}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)

    return {d: (len(sets[d]), c) for d, c in brute_components(sorted(sets), linked).items()}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for group in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(25):  # a chain: each differs a little from the one before
            for _ in range(max(1, len(text) // 90)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append((" ".join(text)))
    docs += [docs[0], docs[0].upper(), "", None, "just two", "JUST two", "two just"]
    order = list(range(len(docs)))
    rng.shuffle(order)
    docs = list(zip(order, docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.duplicate_classes(df, width, 80).collect()}
        assert got == brute_classes(docs, width, 80)


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(80)] = f"x{rng.randrange(9)}"
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.duplicate_classes(df, 4, 80, rounds=0).collect()}
    assert got == brute_classes(docs, 4, 80)


def test_near_duplicate_edges(odd_docs, no_docs):
    out = minhash.duplicate_classes(odd_docs, 4, 80).collect()
    want = brute_classes([(r.doc_id, r.text) for r in odd_docs.collect()], 4, 80)
    assert len(out) == odd_docs.count()
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.duplicate_classes(no_docs).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for like in (0.8, 0.9, 0.97):
        missed = 0
        for _ in range(200):
            n = 1000
            shared = int(n * 2 * like / (1 + like))
            pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
            x, y = (minhash.odd_sketch(minhash.min_hashes(s)) for s in (a, b))
            missed += int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) > minhash.most_flips(80)
        assert missed == 0


# -- repeated passages ----------------------------------------------------------------------------

def brute_removal(docs, window):
    texts = {d: WORD.findall(t or "") for d, t in docs if d is not None}
    seen, out = set(), {}
    for d in sorted(texts):
        words, gone = texts[d], [False] * len(texts[d])
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passages(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", " ", "A", "a"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    out = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        out.append((i * 3 - 50, " ".join(text)))
    return out + [(1000, out[5][1]), (1001, None), (1002, ""), (1003, "same " * 90), (1004, "same " * 50)]


@pytest.mark.parametrize("hot", [10_000, 2])
def test_repeats_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    for seed, window in ((1, 20), (2, 8)):
        docs = passages(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, window).collect()}
        assert got == brute_removal(docs, window)


def test_repeat_edges(odd_docs, no_docs):
    out = substring.remove_repeats(odd_docs).collect()
    want = brute_removal([(r.doc_id, r.text) for r in odd_docs.collect()], 20)
    assert len(out) == odd_docs.count()
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert substring.remove_repeats(no_docs).count() == 0


def test_backward_search_by_brute_force():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 400)
    text[::23] = 0
    text[-1] = 0
    index = substring.FMIndex(text.astype(np.int64))
    for _ in range(300):
        at, n = rng.integers(0, 390), rng.integers(1, 6)
        word = text[at : at + n]
        if (word == 0).any():
            continue
        lo, hi = np.array([0]), np.array([len(text)])
        for c in word[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == word).all()]
        assert hi[0] - lo[0] == len(places)
        assert index.first_place(lo, hi)[0] == min(places)
        assert sorted(index.places[lo[0] : hi[0]]) == places


# -- secrets --------------------------------------------------------------------------------------

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
}


def brute_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            length = len(m[2]) if kind == "assign" else len(m[0])
            if length >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), i, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_base_spans_by_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(7)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " = ", "'", '"', "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef",
             "deadbeef", "\U0001f600", "é", " ", "\n", "abcdefghijkl", "x.y-z/", "9f", "token=password: abcdefghijkl123"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(800)] + [(900, None)]
    for df in (spark.createDataFrame(docs, "doc_id long, text string"), odd_docs):
        texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        for r in secrets.report(df).collect():
            want = brute_spans(texts[r.doc_id])
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert set(want) <= set(r.spans.split(",") if r.spans else [])
    assert secrets.report(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


def test_the_battery_finds_keys_among_words(spark):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["tion", "ing", "er", "the", "and", "ou", "ment", "ness", "able", "ish"]
    docs = []
    for i in range(400):
        words = ["".join(rng.choice(syllables) for _ in range(9))[:40].ljust(30, "e") for _ in range(3)]
        key = "".join(rng.choice(letters) for _ in range(40)) if i % 4 == 0 else "a1" * 15
        docs.append((i, " ".join([words[0], key, *words[1:]])))
    out = secrets.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = [r.doc_id for r in out if r.n_random]
    assert all(i % 4 == 0 for i in found) and len(found) >= 85


@pytest.mark.parametrize("n", [40, 400])
def test_long_keys_are_found_at_every_size(spark, n):
    """Prose without a long word, and among its keys others of the same length that are not random."""
    rng = random.Random(31)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "the water over there was still in old valley when morning light began to show people walking along narrow river banks".split()
    docs = []
    for i in range(n):
        key = "".join(rng.choice(letters) for _ in range(40)) if i % 2 else "/".join(rng.choice(words) for _ in range(12))[:40]
        # Words of 20 to 24 letters, which pass easily.
        short = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 22))
        docs.append((i, " ".join([*rng.choices(words, k=80), short, key, *rng.choices(words, k=80)])))
    out = secrets.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = [r.doc_id for r in out if r.n_random]
    assert all(i % 2 for i in found) and len(found) >= 0.6 * n / 2


def test_joined_words_have_the_lengths_of_all_classes(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(6000))
    rows = spark.createDataFrame([(text + " x1y abc/def " + "q" * 30,), ("one two",), (None,)], "text string")
    out = [r.w for r in rows.select(F.explode(secrets.joined(F.col("text"))["word"]).alias("w")).collect()]
    whole = text.replace(" ", "")
    assert "".join(out) == whole[: len("".join(out))] and len(whole) - len("".join(out)) < 200
    sizes = Counter(sum(len(w) > c for c in secrets.CLASSES) for w in out)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(len(w) >= secrets.LEAST for w in out)
    cut = secrets.joined(F.col("text"))
    both = rows.select(secrets.battery(cut).alias("a"), secrets.battery(cut, plain=True).alias("b")).where("size(a) > 0").first()
    assert both.a == both.b


def test_redaction_leaves_no_span(odd_docs):
    out = secrets.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[17] == f"{secrets.MARK} x {secrets.MARK}" .replace(f"{secrets.MARK} x", f'{secrets.MARK}" x')
    assert text[7] is None and text[8] == ""
    before = {r.doc_id: r.text for r in odd_docs.collect()}
    assert all(text[k] == before[k] for k in text if k != 17)


# -- language and quality -------------------------------------------------------------------------

def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    out = language.identify(docs, model)
    told = out.where(language.held_out() & F.col("lang").isNotNull()).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r.lang_pred for r in told]) >= 0.97
    assert all(0 <= r.score <= 1 for r in told)


def test_mixtures_show_their_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    text = {r.lang: r.text for r in docs.where("lang in ('en', 'de') AND n_chars > 900").collect()}
    both = (text["en"][:600] + " " + text["de"][:300]).lower().encode()
    share = model.mixtures([both, text["en"][:600].lower().encode(), b"", b"123 !!"])
    names = np.array(model.languages)
    assert set(names[share[0] > 0]) == {"en", "de"} and share[0][names == "en"][0] > share[0][names == "de"][0]
    assert set(names[share[1] > 0]) == {"en"} and not share[2:].any()


def test_language_edges(odd_docs, no_docs, spark):
    model = language.fit(odd_docs)
    out = language.identify(odd_docs.drop("score"), model)
    for r in out.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred in ((set(model.languages)) if lettered else {"und"}), r.doc_id
    empty = language.fit(no_docs)
    assert empty.languages == []
    assert {r.lang_pred for r in language.identify(odd_docs, empty).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0


def test_quality_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where(quality.held_out()).collect()
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.9
    assert all(0 <= r.score <= 1 for r in out)
    again = quality.fit(docs, labels)
    assert np.allclose(again.w1, model.w1) and again.temperature == model.temperature


def test_word_vectors_cover_rows_without_a_label(spark):
    docs = [(i, f"red apple tree number{i} grows") for i in range(20)] + [(i, f"unheard zebra stripes pattern{i} runs") for i in range(100, 120)] + [(None, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    one = quality.units(b"zebra")[0][0]
    assert np.linalg.norm(model.vectors[one]) > 0.9
    places, signs = quality.index_vectors()
    texts = [r.text.encode() for r in docs.where("text IS NOT NULL").collect()]
    alone = sum(quality.context_sums([t], places, signs) for t in texts)
    assert np.array_equal(quality.context_sums(texts, places, signs), alone)


def test_equal_pairs_of_near_units_are_summed_once(monkeypatch):
    """A text that repeats its words adds one count per distinct pair, not one per place."""
    places, signs = quality.index_vectors()
    text = b"alpha Beta 17 " * 3000
    seq, want = quality.units(text)[0], np.zeros((quality.UNITS, quality.DIM))
    for gap in range(1, quality.REACH + 1):
        for a, b in ((seq[:-gap], seq[gap:]), (seq[gap:], seq[:-gap])):
            for k in range(quality.SIGNS):
                np.add.at(want, (a, places[b, k]), signs[b, k])
    added, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a: added.append(len(x)) or plain(x, *a))
    assert np.array_equal(quality.context_sums([text], places, signs), want.ravel())
    assert max(added) <= 200


def test_quality_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None), (None, 1), (7, 0)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    out = quality.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    untaught = quality.fit(no_docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, untaught).collect()} == {0.5}
