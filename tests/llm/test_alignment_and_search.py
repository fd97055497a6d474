"""Token alignment, exact top-k and conversation repair beside plain versions."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from gradeline.llm import exact_topk, queries, repair, token_links

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


# -- token alignment ---------------------------------------------------------------------------


def plain_alignment(rows):
    """The contract over (doc_id, text) rows, token by token on whole texts."""
    a_tok = tokenizers.Tokenizer.from_file(FILES[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in shown)}
    seen, docs = Counter(), []
    for ident, text in rows:
        found = None
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
            b_bytes = [
                bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
                for i in b
            ]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = [list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
                links, j = [], 0
                for i, end in enumerate(ends[0]):
                    start = end - len(a_bytes[i])
                    while ends[1][j] <= start:
                        j += 1
                    k = j
                    while k < len(b) and (ends[1][k - 1] if k else 0) < end:
                        links.append((a[i], b[k]))
                        k += 1
                cuts = sorted(set(ends[0]) & set(ends[1]))
                at = {c: n for n, c in enumerate(cuts)}
                groups = [([], []) for _ in cuts]
                for side, (ids, es) in enumerate(((a, ends[0]), (b, ends[1]))):
                    n = 0
                    for t, e in zip(ids, es):
                        groups[n][side].append(str(t))
                        n = at[e] + 1 if e in at else n
                groups = ["|".join(map(",".join, g)) for g in groups]
                found = (len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
                seen.update(set(links))
        docs.append((ident, found))
    most = defaultdict(int)
    for (a, _), n in seen.items():
        most[a] = max(most[a], n)
    out = []
    for ident, found in docs:
        if found is None:
            out.append((ident, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, sha = found
            out.append((ident, n_a, n_b, n_groups, len(links), sum(seen[p] == most[p[0]] for p in links), sum(seen[p] for p in links), sha))
    return Counter(out)


def aligned(df):
    return Counter(tuple(r) for r in token_links.align(df, *FILES).collect())


ODD = [
    "", None, " ", "a", "<|endoftext|> stays <s> text </s>", "café 中文字 \U0001f600\U0001f468‍\U0001f469", "under▁score",
    "<0x41> literal", "two  blanks and\ttabs\n\nand lines ", "x" * 9000, "中文" * 6000, "ab cd " * 4000, "\x00\x01 odd ﻿", "ﬁ ligature é",
]


def test_alignment_equals_plain_version(spark, odd_docs, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "b"), (None, "null id"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, block long, s string")
    assert aligned(df) == plain_alignment(rows)
    whole = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert aligned(odd_docs) == plain_alignment(whole)


def test_alignment_of_the_whole_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op11_token_alignment"](spark, sf)
    assert Counter(tuple(r) for r in got.collect()) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_nothing(spark, no_docs):
    assert token_links.align(no_docs, *FILES).collect() == []


def test_lanes_and_blocks_do_not_change_results(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    both = token_links.sides(*FILES)

    def records():
        block = token_links.Block(both)
        for ident, text in docs:
            block.add(ident, text)
        r = block.record(0)
        ends = [0, *r["ends"]]
        pairs = [Counter(dict(zip(r["pairs"][r["places"][a:b]].tolist(), r["times"][a:b].tolist()))) for a, b in zip(ends, ends[1:])]
        return [list(r[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "shas")], pairs, dict(zip(r["pairs"].tolist(), r["docs"].tolist()))

    want = records()
    monkeypatch.setattr(token_links, "LANE", 4)
    monkeypatch.setattr(token_links, "AT_ONCE", 3000)
    assert records() == want
    monkeypatch.setattr(token_links, "LANE", 1 << 40)
    monkeypatch.setattr(token_links, "LONG_LANE", 16)
    assert records() == want
    monkeypatch.setattr(both, "cuts", False)
    assert records() == want


def test_a_text_of_twenty_megabytes(spark):
    rng = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "café", "12,5", "unbelievable", "(sic)"]
    text = " ".join(rng.choice(words) for _ in range(3_000_000))
    assert len(text) > 16e6
    r = token_links.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *FILES).first()
    assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_groups > 3_000_000
    assert r.n_best <= r.n_links == r.count_sum


# -- exact top-k -------------------------------------------------------------------------------


def plain_topk(rows, step, k):
    from math import floor, isfinite

    usable = [(i, [floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q is None or q % step:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w)), (i is None, i or 0), i) for i, w in usable if i != q)
        out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(near[:k], 1)]
    return Counter(out)


def searched(spark, rows, step, k):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, q int")
    return Counter(tuple(r) for r in exact_topk.nearest(df, F.col("vec_id") % step == 0, k=k).collect())


def floats(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_a_task_of_many_blocks_keeps_few_of_them(spark, monkeypatch):
    """Blocks are written in small row groups, met by sorted rows, and read by the libraries a part at a time."""
    import pyarrow.parquet as pq
    from gradeline.llm.common import written

    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 1 << 30, 300_000).tolist()) for i in range(60)]
    table = written(spark.createDataFrame(rows, "block long, places array<int>").coalesce(1), "few", token_links.FEW_BLOCKS)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in table.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= 20
    docs = spark.createDataFrame([(i, f"some words {i % 3} here") for i in range(9)], "doc_id long, text string")
    plan = token_links.align(docs, *FILES)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    taken, merged = [], token_links.merged
    monkeypatch.setattr(token_links, "merged", lambda a, *rest: taken.append(len(a)) or merged(a, *rest))
    block = token_links.Block(token_links.sides(*FILES))
    for i in range(8):
        block.add(i, " ".join(f"word{n}" for n in range(i, 50_000)))
    block.record(0)
    assert len(taken) > 1 and max(taken) < 0.6 * sum(taken)


@pytest.mark.parametrize("block", [60, 2048])
def test_topk_with_ties_copies_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "ROW_BLOCK", block)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0, 3.75]) for _ in range(3)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(150, 260)]
    rows += [(20, [1.0, 2.0, 3.0]), (150, [0.5, 0.5, 0.5]), (300, None), (310, [None, 1.0, 1.0]), (320, [float("nan"), 0.0, 0.0]),
             (330, [float("inf"), 0.0, 0.0]), (340, []), (350, [1.0]), (None, [0.5, 0.5, 0.5]), (None, [9.0, 9.0, 9.0]), (-10, [-0.0005, 1e-9, 0.0])]
    rows = floats(rows)
    assert searched(spark, rows, 10, 10) == plain_topk(rows, 10, 10)


def test_topk_of_few_or_no_rows(spark):
    assert searched(spark, [], 10, 10) == Counter()
    assert searched(spark, [(1, [1.0])], 10, 10) == Counter()
    assert searched(spark, [(10, [1.0])], 10, 10) == Counter()
    few = floats([(10, [1.0, 2.0]), (11, [0.1, 0.3]), (12, [0.1, 0.3])])
    assert searched(spark, few, 10, 10) == plain_topk(few, 10, 10)


def test_topk_of_large_numbers_is_exact(spark):
    rows = floats([(i, [(-1) ** i * (2.0**17 + 0.25 * i), 2.0**16 + i, 0.001 * i]) for i in range(40)])
    assert searched(spark, rows, 10, 5) == plain_topk(rows, 10, 5)
    with pytest.raises(ValueError):
        searched(spark, floats([(i, [1e30]) for i in range(20)]), 10, 5)


# -- conversation repair -----------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit, lines) of the cheapest repair of (role, text, must_go, kept) rows, by trying every
    edit; at most two insertions between rows."""
    best = None

    def legal(initials):
        rest = initials[1:] if initials[:1] == "s" else initials
        return initials == "" or (rest and rest == "ua" * (len(rest) // 2))

    def go(i, cost, audit, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            for more in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
                whole = lines + [f"{r}:" for r in more]
                if legal("".join(x[0] for x in whole)):
                    found = (cost + 3 * len(more), audit + "I" * len(more), whole)
                    best = min(best, found) if best else found
            return
        role, text, must_go, kept = rows[i]
        for more in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            at, before, said = cost + 3 * len(more), audit + "I" * len(more), lines + [f"{r}:" for r in more]
            go(i + 1, at + 4, before + "D", said)
            if not must_go:
                go(i + 1, at + kept, before + "K", [*said, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    go(i + 1, at + kept + 3, before + "R", [*said, f"{r}:{text}"])

    go(0, 0, "", [])
    return best


def plain_repair(conv, rows):
    """The expected row of one conversation from (turn, role, text) rows in order."""
    blanks = " \t\n\x0b\x0c\r"
    seen, marked, counts = set(), [], Counter()
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        bare = text.strip(blanks)
        blank, dup = not bare, bool(bare) and (role, text) in seen
        cut = bool(bare) and not dup and bare[-1] not in ".!?"
        seen.add((role, text))
        counts.update(blank=blank, duplicate=dup, truncated=cut)
        marked.append((role, text, blank or dup, 3 * cut))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, lines = cheapest(marked)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


TEXTS = ["Yes.", "No!", "why", "Well?  ", " \t", "", "é.", None, "tail. \x0b", "line\nbreak."]
ROLES = ["user", "assistant", "system", "tool", "user", "assistant", "Ureal", None]
SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string"


def repaired(df, every=None, **more):
    return Counter(tuple(r) for r in repair.repair(df, every, **more).collect())


@pytest.mark.parametrize("segment", [2, 512])
def test_repair_equals_trying_every_edit(spark, segment):
    rng = random.Random(11)
    rows, want = [], []
    for conv in [None, *range(60)]:
        n = rng.randint(1, 5)
        own = [(None if i == 0 and rng.random() < 0.2 else 2 * i, rng.choice(ROLES), rng.choice(TEXTS)) for i in range(n)]
        rows += [(conv, *r, 7, "x") for r in own]
        want.append(plain_repair(conv, own))
    got = repaired(spark.createDataFrame(rows, SCHEMA), segment=segment)
    assert got == Counter(want)


def test_repair_of_one_hot_conversation_in_pieces(spark):
    """The same conversation as a whole and in pieces of 4 and 64 rows; repeated rows in it."""
    rng = random.Random(3)
    own = [(i, rng.choice(["user", "assistant"] if rng.random() < 0.9 else ROLES), rng.choice([f"say {i}.", f"cut {i}", "again."])) for i in range(300)]
    df = spark.createDataFrame([(1, *r, 0, "") for r in own], SCHEMA).repartition(4)
    whole = repaired(df, segment=512)
    assert len(whole) == 1 and [repaired(df, segment=n) for n in (4, 64)] == [whole] * 2


def test_repair_with_ties_repeats_and_empty_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 5, "system", "Only.")]
    every = spark.createDataFrame([(1,), (2,), (3,), (None,), (3,)], "conv_id long")
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA), every).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (got[1].duplicate, got[1].cost, got[1].audit) == (1, 4, "KDK")
    assert (got[2].cost, got[2].audit, got[2].repaired_sha256) == (4, "D", none)
    assert tuple(got[3])[1:] == tuple(got[None])[1:] == (0, 0, 0, 0, 0, 0, "", none) and len(got) == 4
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_damage_follows_the_hash_of_the_place(spark):
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in ((0, "system", "A. b!"), (1, None, "C?"), (None, "assistant", None))]
    want = Counter()
    for c, t, r, x in rows:
        fault = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = {1: "", 2: x.translate({ord(m): None for m in ".!?"})}.get(fault, x)
        want[(c, t, "user" if fault == 4 else r, x)] += {0: 0, 3: 2}.get(fault, 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r) for r in repair.damaged(df).collect()) == +want
