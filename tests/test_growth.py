"""What the larger tables asked for: rows dealt once, and pages settled without a walk of each."""

import numpy as np

from pyspark.sql import functions as F

from gradeline.functions import pages as pg
from gradeline.functions.hashing import with_cluster_draw
from gradeline.operators import layout, payloads, stats
from gradeline.plans import page_layout, relations
from gradeline.session import written


def test_pages_are_made_where_their_lines_lie(spark, sf):
    """Only lines are dealt out; the blocks made of them are neither shuffled nor joined."""
    plan = layout.match_blocks(page_layout.pairs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Union" not in plan


def test_pages_made_of_lines_are_those_of_the_two_tables(spark, sf):
    columns = ["page_id", "processor", "gt", "pred"]
    whole = layout.page_pairs(
        page_layout.truth(spark, sf), page_layout.predictions(spark, sf), page_layout.PROCESSORS).select(*columns)
    made = page_layout.pairs(spark, sf).select(*columns)
    assert made.count() == whole.count() > 0
    assert made.exceptAll(whole).isEmpty() and whole.exceptAll(made).isEmpty()


def test_split_blocks_need_no_walk_of_their_page(monkeypatch):
    """Pages of whole and split blocks: no assignment and no recovery page by page."""
    rng = np.random.default_rng(4)
    p, g = [], []
    for line in range(4):
        w, shift = 100 + 30 * line, int(rng.integers(5, 60))
        g.append(("t", (0, 60 * line, w, 50)))
        half = w * 9 // 20
        p += [("t", (shift, 60 * line, half, 50)), ("t", (shift + half, 60 * line, w - half, 50))]
    make = lambda rows: pg.boxes([{"kind": k, "bbox": dict(zip("xywh", b))} for k, b in rows])
    one_p, one_g = make(p), make(g)
    n = 50

    def side(boxes):
        tiled = pg.Boxes(*(np.tile(getattr(boxes, c), n) for c in ("x", "y", "w", "h")), np.zeros(len(boxes) * n, int), np.tile(boxes.valid, n))
        return pg.Side(np.arange(n + 1) * len(boxes), tiled)

    pairs, splits, merges = pg.match_with_recovery(one_p, one_g, 0.5, 28.0, True)
    confidence = rng.random(len(one_p) * n)
    want_hits = [pg.greedy_hits(one_p, one_g, c, [0.3, 0.5]) for c in confidence.reshape(n, -1)]
    walked = []
    for name in ("assigned", "recover_both", "greedy_rows"):
        monkeypatch.setattr(pg, name, lambda *a, name=name: walked.append(name))
    batch = pg.Batch(side(one_p), side(one_g))
    i, j = batch.pairs(0.5, True)
    found = batch.records(i, j, 0.5, np.full(n, 28.0))
    classes = batch.by_class(0.5, np.full(n, 28.0))
    hits = batch.hits(confidence, [0.3, 0.5])
    assert walked == []
    assert found == ([splits] * n, [merges] * n) and len(splits) > 0
    assert len(i) == n * len(pairs) and classes["splits"].tolist() == [len(splits)] * n
    assert np.array_equal(hits.reshape(n, -1, 2), np.stack([h.T for h in want_hits]))


def test_ignoring_in_pages_is_ignoring_blocks(spark, sf):
    t, p = page_layout.truth(spark, sf), page_layout.predictions(spark, sf)
    columns = ["page_id", "processor", "gt", "pred"]
    for mode in page_layout.IGNORE_MODES:
        blocks = [layout.ignore_blocks(side, mode, ["footer"]) for side in (t, p)]
        want = layout.page_pairs(*blocks, page_layout.PROCESSORS).where("size(gt) + size(pred) > 0").select(*columns)
        got = layout.ignore_in_pages(page_layout.pairs(spark, sf), mode, ["footer"]).where("size(gt) + size(pred) > 0").select(*columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_sessions_hold_every_event(spark, sf):
    """Sessions that are still open at the end are given too."""
    from gradeline.plans import intake, relations

    got = intake.collection_sessions(spark, sf).agg({"n": "sum"}).first()[0]
    assert got == relations.table(spark, sf, "events").count()


def test_shown_answers_are_all_without_an_error(spark, sf):
    from gradeline.plans import intake, relations
    from gradeline.sources import files

    got = intake.shown_answers(spark, sf).agg({"n": "sum"}).first()[0]
    rows = relations.scored(spark, sf).where("q % 31 <> 0 AND q % 29 <> 0 AND has_answer AND error IS NULL")
    assert got == rows.count()
    held = spark.createDataFrame([('{"qid": "q1", "parser": "a", "answer": {}, "error": null}',)], "value string")
    assert files.shown_answers(files.parse_answers(held)).isEmpty()


def test_stored_rows_are_scored_again_without_joining_them_to_themselves(spark, sf):
    from gradeline.plans import accuracy

    plan = accuracy.rescore(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Lines to orders for stored rows and bank, bank to answers, and two tables of one row per system.
    assert plan.count("Join ") <= 5


def test_resampling_makes_no_row_per_draw(spark):
    """Weights are made as a matrix where the documents lie, and equal those of the column steps."""
    rows = [(f"d{i}" if i else None, leg, dom, s) for i in range(60) for leg in ("a", "b", None) for dom in ("x", None)
            for s in (["correct"] * (i % 3) + ["error"]) if (i + len(leg or "")) % 5]
    out = spark.createDataFrame(rows, "doc string, parser string, domain string, status string")
    got = stats.resample(out, ["domain"], iters=9, seed=3)
    assert "Generate explode(sequence" not in got._jdf.queryExecution().optimizedPlan().toString()
    docs = stats.per_cluster(out, ["domain", "parser"]).withColumn("it", F.explode(stats.iterations(9, stats.PLAIN)))
    docs = with_cluster_draw(docs, "h", 3, F.greatest("it", F.lit(0)), "doc")
    want = {}
    for r in docs.collect():
        w = 1 if r.it == stats.PLAIN else sum(r.h >= t for t in stats.POISSON) if r.h is not None else 0
        total = want.setdefault((r.domain, r.parser, r.it), [0, 0, 0])
        for i, v in enumerate((w * r.n, w * r.c, int(w > 0))):
            total[i] += v
    assert {(r.domain, r.parser, r.it): [r.n, r.c, r.n_docs] for r in got.collect()} == {k: v for k, v in want.items() if v[2]}


def test_cells_of_a_table_are_worked_out_once(spark):
    """Not again for every place of the grid; gaps stay empty and the last cell of a place wins."""
    assert str(payloads.grid_table(F.col("heavy"))).count("heavy") == 1
    rows = [([(1, 1, "a"), (3, 2, "x"), (1, 1, "b"), (2, 2, None)],), ([],), ([(1, 1, "one")],)]
    df = spark.createDataFrame(rows, "cells array<struct<r:int,c:int,text:string>>")
    got = [r.md for r in df.select(payloads.grid_table(F.col("cells")).alias("md")).collect()]
    assert got == ["| b |  |\n|---|---|\n|  |  |\n|  | x |", "", "| one |\n|---|"]


def test_parts_of_line_work_grow_with_the_table(spark, sf, monkeypatch):
    """A larger table gets more parts, not larger ones, and scores by class need no other matching."""
    monkeypatch.setattr(relations, "LINES_PER_TASK", 100)
    lines = relations.table(spark, sf, "lineitem").count()
    assert relations.line_parts(spark, sf) == -(-lines // 100) > relations.shuffle_parts(spark)
    rows = page_layout.pairs(spark, sf)
    dealt = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in dealt and f"], {-(-lines // 100)}" in dealt
    plan = layout.data_set_score(rows, ["processor"])["macro"]._jdf.queryExecution().optimizedPlan().toString()
    assert "matched" not in plan and "classes" in plan


def test_pages_are_matched_once_for_average_precision(spark, sf, monkeypatch):
    """The walk, its cut points and the names of the classes read what one pass of the kernel left."""
    kept = []
    monkeypatch.setattr(layout, "written", lambda df, name: kept.append(name) or written(df, name))
    hits = layout.greedy_hits(page_layout.pairs(spark, sf))
    ap = layout.average_precision(hits, page_layout.truth(spark, sf))
    assert kept == ["hits"]
    assert "EvalPython" not in ap._jdf.queryExecution().executedPlan().toString() and ap.count() > 0


def test_wide_rows_join_bank_and_cells_once(spark, sf):
    """All values of a system come from one written join, cells without gold fields too."""
    from gradeline.operators import metrics, reports

    bank, scored = relations.bank(spark, sf), relations.scored(spark, sf)
    bank = bank.withColumn("fields", F.when(F.col("q") % 5 == 0, F.slice("fields", 1, 0)).otherwise(F.col("fields")))
    rows = reports.row_metrics(bank, scored, relations.SYSTEMS, iters=20)
    assert "l_orderkey" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r.parser: r for r in rows.collect()}
    assert len(got) == len(relations.SYSTEMS)
    for want in (metrics.strict_accuracy, metrics.row_coverage):
        for r in want(bank, scored, relations.SYSTEMS).collect():
            assert all(got[r.parser][c] == r[c] for c in r.asDict())
    for r in metrics.error_class_counts(bank, scored, relations.SYSTEMS).collect():
        assert got[r.parser].error_classes[r["class"]] == r.n


def test_verdicts_run_compiled(spark, sf):
    """No generated method of the field verdicts is longer than what the JVM compiles (8,000 bytes)."""
    import re

    from gradeline.plans import accuracy

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = accuracy.field_verdicts(spark, sf)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert 0 < max(sizes) < 8000


def test_bare_text_is_the_normal_form_without_space(spark):
    """One form of each side decides as the normal form and its spaceless form did."""
    import random

    from gradeline.functions import text

    rng = random.Random(3)
    parts = ["a", "B", " ", "\u00a0", "\u2009", "\t", "*", "**", "_", "__", "`", "<", ">", "<br/>", "<b>", "</i >", "-", "\u2013", "\u2212", "/", ":", ",", "\u2019", "\u201d", "\u00e9", "\U0001f600"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string")
    same = (text.bare_text(F.col("t")) == text.remove_space(text.normalize_text(F.col("t"))))
    assert df.where(~same).isEmpty()


def test_blocks_are_parsed_once_for_all_lines(spark):
    """The tables of a payload are found once, not once for each of its lines."""
    box = lambda top: f'"Geometry":{{"BoundingBox":{{"Left":0.2,"Top":{top},"Width":0.1,"Height":0.1}}}}'
    block = lambda i, kind, more: f'{{"Id":{i},"BlockType":"{kind}"{more}}}'
    blocks = [
        block('"L1"', "LINE", "," + box(0.2)), block('"L2"', "LINE", "," + box(0.8)), block('"L3"', "LINE", ""), block("null", "LINE", "," + box(0.3)),
        block('"T1"', "TABLE", ""), block('"T2"', "TABLE", ',"Geometry":{"BoundingBox":{"Left":0,"Top":0,"Width":0.9,"Height":0.5}}'),
    ]
    rows = [(0, '{"Blocks":[' + ",".join(blocks) + "]}"), (1, '{"Blocks":[]}'), (2, "{}"), (3, None), (4, '{"Blocks":[' + blocks[0] + "]}")]
    df = spark.createDataFrame(rows, "i int, payload string").repartition(1)
    got = []
    for schema in (payloads.TEXTRACT_SCHEMA, payloads.TEXTRACT_PLACES):
        found = df.select("i", payloads.lines_in_tables(F.from_json("payload", schema)["Blocks"]).alias("ids"))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        got.append({r.i: r.ids for r in found.collect()})
    assert got[0] == got[1] == {0: ["L1", None], 1: [], 2: None, 3: None, 4: []}


def test_permutations_make_no_row_per_draw(spark):
    """Signs are made as a matrix where the documents lie, and sums equal those of the column steps."""
    rows = [(f"d{i}" if i else None, leg, s) for i in range(60) for leg in ("a", "b", "c", None)
            for s in (["correct"] * ((i * 7 + len(leg or "xx") + ord((leg or "z")[0])) % 4) + ["error"]) if (i + ord((leg or "z")[0])) % 5]
    out = spark.createDataFrame(rows, "doc string, parser string, status string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "gone"), ("a", "a"), ("no", "none")], "a string, b string")
    tests = stats.permutation_test(out, pairs, iters=40, seed=5)
    assert "Generate explode(sequence" not in tests._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a, r.b): (r.observed, r.n_docs, r.n_moved, round(r.p * 41) - 1) for r in tests.collect()}
    docs = stats.paired_clusters(out, pairs, []).withColumn("d", F.col("ca") - F.col("cb"))
    draws = with_cluster_draw(docs.withColumn("it", F.explode(stats.iterations(40))), "h", 5, F.col("it"), "doc")
    want = {}
    for r in docs.collect():
        w = want.setdefault((r.a, r.b), [0, 0, 0, [0] * 40])
        w[0], w[1], w[2] = w[0] + r.d, w[1] + 1, w[2] + (r.d != 0)
    for r in draws.collect():
        want[r.a, r.b][3][r.it] += r.d if r.h is not None and r.h & 65536 == 0 else -r.d
    assert got == {k: (o, n, m, sum(abs(x) >= abs(o) for x in s)) for k, (o, n, m, s) in want.items()} and len(got) == 4


def test_no_row_per_key_is_shuffled_for_the_browser(spark, sf):
    """Keys are expanded last: nothing is joined or grouped above that step."""
    from gradeline.plans import accuracy

    plan = accuracy.question_browser(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Join" not in above and "Aggregate" not in above
