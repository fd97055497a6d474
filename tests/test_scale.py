"""Selection, prefix sums, frontiers and the page kernel: right, and no task with a whole group."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.functions import pages as pg
from gradeline.functions import prefix
from gradeline.operators import layout, reports
from gradeline.operators import transcripts as tr
from gradeline.sources import files, rewrite


@pytest.fixture
def spread(spark):
    """Shuffles into 40 partitions that are not merged, as on a cluster."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(spark, name, action):
    """Result of an action, and the rows that each of its tasks read from shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, read = sc.statusTracker(), sc._jsc.sc().statusStore(), []
    for job in tracker.getJobIdsForGroup(name):
        for stage in tracker.getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 10_000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    read.append(metrics.get().shuffleReadMetrics().recordsRead())
    return out, read


def hot_rows(spark, n=20_000):
    """99 % of the rows are of one leg; its values take a few thousand steps."""
    return spark.range(n).select(
        F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("leg"), "id",
        (F.pmod(F.xxhash64("id"), F.lit(4001)) / 7.0).alias("v"),
    ).repartition(16)


def test_ranks_of_a_hot_group(spread):
    rows = hot_rows(spread)
    ranks = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}
    got, read = shuffled(spread, "ranks", lambda: prefix.rank_values(rows, ["leg"], "v", ranks).collect())
    values = defaultdict(list)
    for r in rows.collect():
        values[r.leg].append(r.v)
    for r in got:
        v = sorted(values[r.leg])
        assert (r.low, r.mid, r.top) == (v[0], v[len(v) // 2], v[-1])
    # The 16 input tasks send at most one row per part of a range; nothing is near the 19,800 rows.
    assert max(read) <= 16 * (prefix.PARTS + 2)
    few = {"mid": ranks["mid"]}
    _, read = shuffled(spread, "few", lambda: prefix.rank_values(rows, ["leg"], "v", few, parts=8).collect())
    # Each task's share of the input itself is the most that any reads.
    assert max(read) <= 20_000 / 16 + 10


def test_ranks_of_odd_values(spark):
    rng = random.Random(1)
    inf = math.inf
    groups = {
        "ties": [1.5] * 50, "one": [3.0], "wide": [-1e308, 1e308, 0.0, 5e-324, -5e-324, inf, -inf],
        "tiny": [1 + k * 2**-52 for k in range(300)], "mixed": [rng.choice([0.0, rng.gauss(0, 1), 1e9]) for _ in range(400)], None: [2.0, 1.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in prefix.rank_values(df, ["g"], "v", {"mid": lambda n: F.floor(n / 2)}, parts=4).collect()}
    assert {g: r.mid for g, r in got.items()} == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}
    longs = [2**62 + k for k in range(9)]
    df = spark.createDataFrame([("a", v) for v in longs], "g string, v bigint")
    assert prefix.rank_values(df, ["g"], "v", {"x": lambda n: F.lit(6)}).first().x == longs[6]
    two = prefix.medians(spark.createDataFrame([("a", 1), ("a", 4)], "g string, v int"), ["g"], "v").first()
    assert two["median"] == 2.5


def test_prefix_sums_of_a_hot_group(spread):
    rows = hot_rows(spread)
    got, read = shuffled(
        spread, "sums", lambda: prefix.prefix_sums(rows, ["leg"], [F.desc("v"), "id"], {"run": "id"}).collect()
    )
    by_leg = defaultdict(list)
    for r in rows.collect():
        by_leg[r.leg].append((-r.v, r.id))
    want = {}
    for leg, items in by_leg.items():
        total = 0
        for _, i in sorted(items):
            total += i
            want[i] = total
    assert {r.id: r.run for r in got} == want
    assert max(read) < 0.2 * len(want)


def test_dense_numbers_follow_the_order(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = {r.id: r.ord for r in prefix.dense_numbers(rows, ["k", "id"]).collect()}
    assert [got[i] for i in sorted(range(1000), key=lambda i: (i * 7919 % 1009, i))] == list(range(1000))


def test_frontier_with_an_outlier_moves_few_rows(spread):
    rng = np.random.default_rng(2)
    points = [(float(x), float(y)) for x, y in rng.random((5000, 2))] + [(1e18, 0.5), (1e18, 2.0), (0.5, None), (None, 1.0), (0.1, 0.2), (0.1, 0.2)]
    df = spread.createDataFrame(points, "x double, y double").repartition(8)
    got, read = shuffled(spread, "frontier", lambda: reports.frontier(df).collect())
    real = {p for p in points if None not in p}
    want = {(x, y) for x, y in real if not any((a <= x and b >= y and (a, b) != (x, y)) for a, b in real)}
    assert {tuple(r) for r in got} == want
    # Dealing out the input itself reads each row once; after that only frontiers move.
    assert sum(read) <= len(points) + 60 * len(want)
    marked = reports.pareto(df).collect()
    assert len(marked) == len(points) and {(r.x, r.y) for r in marked if r.on_frontier} == want


# -- the page kernel ---------------------------------------------------------------------------


def random_page(rng):
    def side(n):
        return [(rng.choice("abc"), None if rng.random() < 0.05 else (rng.randrange(6) * 20, rng.randrange(6) * 20, rng.randint(-2, 60), rng.randint(10, 60)))
                for _ in range(n)]
    return side(rng.randint(0, 7)), side(rng.randint(0, 7))


def as_boxes(rows):
    return pg.boxes([{"kind": k, "bbox": None if b is None else dict(zip("xywh", b))} for k, b in rows])


def as_side(pages):
    every = as_boxes([b for p in pages for b in p])
    every.kind = np.array(["abc".index(k) for k in every.kind], dtype=int)
    return pg.Side(np.cumsum([0, *map(len, pages)]), every)


@pytest.mark.parametrize("threshold", [0.5, 0.3])
def test_batches_agree_with_single_pages(threshold, monkeypatch):
    monkeypatch.setattr(pg, "AT_ONCE", 20)
    rng = random.Random(7)
    pages = [random_page(rng) for _ in range(150)]
    batch = pg.Batch(as_side([p for p, _ in pages]), as_side([g for _, g in pages]))
    reach = np.full(len(pages), 15.0)
    for typed in (True, False):
        i, j = batch.pairs(threshold, typed)
        splits, merges = batch.records(i, j, threshold, reach)
        for r, (p, g) in enumerate(pages):
            p, g = as_boxes(p), as_boxes(g)
            mine = batch.page_p[i] == r
            own = list(zip((i[mine] - batch.p.starts[r]).tolist(), (j[mine] - batch.g.starts[r]).tolist()))
            want, want_splits, want_merges = pg.match_with_recovery(p, g, threshold, 15.0, typed)
            if len(p) and len(g):
                cost = lambda pairs: sum(1 - pg.iou_grid(p, g)[a, b] + 0.25 * typed * (p.kind[a] != g.kind[b]) for a, b in pairs)
                assert len(own) == len(want) and cost(own) == pytest.approx(cost(want))
            if own == want:
                assert (splits[r], merges[r]) == (want_splits, want_merges)
    found = batch.by_class(threshold, reach)
    rows = {(int(a), "abc"[b]): k for k, (a, b) in enumerate(zip(found["page"], found["kind"]))}
    n = 0
    for r, (p, g) in enumerate(pages):
        for kind in {k for k, _ in p + g}:
            a, b = as_boxes([x for x in p if x[0] == kind]), as_boxes([x for x in g if x[0] == kind])
            pairs, splits, merges = pg.match_with_recovery(a, b, threshold, 15.0, False)
            k = rows[r, kind]
            got = [int(found[c][k]) for c in ("tp", "n_pred", "n_gt", "splits", "split_sources", "merges", "merge_sources")]
            assert got == [len(pairs), len(a), len(b), len(splits), sum(len(s["sources"]) for s in splits), len(merges), sum(len(s["sources"]) for s in merges)]
            n += 1
    assert n == len(rows)
    conf = np.array([rng.random() for _ in range(len(batch.page_p))])
    hits = batch.hits(conf, [0.3, 0.5, 0.8])
    for r, (p, g) in enumerate(pages):
        a, b = batch.p.starts[r], batch.p.starts[r + 1]
        assert hits[a:b].T.tolist() == pg.greedy_hits(as_boxes(p), as_boxes(g), conf[a:b], [0.3, 0.5, 0.8]).tolist()


def test_one_python_node_for_both_scorers(spark, sf):
    from gradeline.plans.page_layout import pairs

    plan = layout.evaluate_cells(pairs(spark, sf), layout.SCORERS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapIn" not in plan


def test_cells_of_empty_and_odd_pages(spark):
    schema = ("page_id int, processor string, idx int, kind string, bbox struct<x:int,y:int,w:int,h:int>,"
              "confidence double, text string, ignore boolean")
    truth = spark.createDataFrame([(1, None, 0, "text", (0, 0, 100, 100), 1.0, None, False), (2, None, 0, None, None, 1.0, None, False)], schema)
    pred = spark.createDataFrame([(1, "p", 0, "table", (0, 0, 100, 100), 0.5, None, False), (3, "q", 0, "text", None, 1.0, None, False)], schema)
    dims = spark.createDataFrame([(1, 1000, 1000)], "page_id int, width int, height int")
    rows = layout.evaluate_cells(layout.page_pairs(truth, pred, ["p", "q"], dims), layout.SCORERS).collect()
    assert len(rows) == 12
    one = {r.scorer: r for r in rows if (r.page_id, r.processor) == (1, "p")}
    assert (one["f1"].strict.tp, one["f1"].strict.fp, one["f1"].strict.fn, one["f1"].adjusted) == (0, 1, 1, None)
    assert (one["adjacency"].strict.tp, one["adjacency"].adjusted.tp) == (1, 1)
    assert one["f1"].confusion == {"table|text": 1} and set(one["f1"].per_class) == {"table", "text"}
    assert set(one["adjacency"].per_class) == {"text"}


def test_groups_of_adjacent_blocks(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for page in range(40):
        boxes = [(rng.choice("ab"), (rng.randrange(8) * 14, rng.randrange(8) * 14, 10, 10)) for _ in range(rng.randint(1, 14))]
        rows += [(page, "p", i, k, b) for i, (k, b) in enumerate(boxes)]
        for kind in "ab":
            idx = [i for i, (k, _) in enumerate(boxes) if k == kind]
            if idx:
                for group in pg.adjacent_groups(as_boxes([boxes[i] for i in idx]), list(range(len(idx))), 5.0):
                    for i in group:
                        want[page, idx[i]] = (idx[group[0]], len(group))
    schema = "page_id int, processor string, idx int, kind string, bbox struct<x:int,y:int,w:int,h:int>"
    dims = spark.createDataFrame([(p, 250, 100) for p in range(40)], "page_id int, width int, height int")
    got = layout.adjacent_groups(spark.createDataFrame(rows, schema), dims).collect()
    assert {(r.page_id, r.idx): (r.group, r["size"]) for r in got} == want


def test_phrases_are_counted_in_the_row(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 300))) for _ in range(30)] + ["", "x", "w w w w w w"]
    want = {}
    for doc, text in enumerate(texts):
        w = text.split()
        n = Counter(tuple(w[i : i + 4]) for i in range(len(w) - 3))
        often = [c for c in n.values() if c >= 3]
        if often:
            want[doc] = (max(often), len(often))
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)] + [("p", 99, None)], "parser string, doc int, text string")
    found = tr.repeated_phrases(df, times=3)
    assert {r.doc: (r.most, r.n_phrases) for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


# -- files and stored tables -------------------------------------------------------------------


def test_layout_stops_at_an_absent_page_and_opens_listed_files_only(spark, tmp_path):
    notes = tmp_path / "annotations"
    notes.mkdir()
    (notes / "p1.json").write_text('{"annotations": []}')
    (notes / "p3.json").write_text('{"layout_dets": []}')
    (notes / "p9.json").mkdir()  # a folder: opening it would fail
    (tmp_path / "manifest.csv").write_text("pageId,domain,sourceUrl,originalImageUrl\np3,a,,\np1,b,,\np2,a,,\n")
    load = lambda **o: files.load_layout(spark, str(tmp_path), **o).orderBy("ord").collect()
    assert [(r.ord, r.page_id) for r in load(limit=2)] == [(0, "p3"), (1, "p1")]
    assert [r.page_id for r in load(absent="skip")] == ["p3", "p1"]
    assert [r.page_id for r in load(absent="skip", limit=2, domains=["a"])] == ["p3"]
    assert [r.annotation is None for r in load(absent="keep")] == [False, False, True]
    with pytest.raises(Exception, match="no annotations for page p2"):
        load()
    assert files.load_layout(spark, f"file://{tmp_path}", limit=1).first().annotation == '{"layout_dets": []}'


def stored_rows(spark):
    rows = [(f"q{i}", p, "gen-1" if i % 2 else None, i) for i in range(20) for p in ("vlm__a", "ocr b/c", None)]
    return spark.createDataFrame(rows, "qid string, parser string, extractor string, v int")


def contents(spark, path):
    return Counter((r.qid, r.parser, r.v, r.asDict().get("generation")) for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("broken", ["_overwrite_partitions", "_drop_partition"])
def test_a_broken_move_is_ended_by_the_next_run(spark, tmp_path, monkeypatch, broken):
    table, archive = str(tmp_path / "live"), str(tmp_path / "archive")
    files.write_snapshot(stored_rows(spark), table)
    before = contents(spark, table)
    real, calls = getattr(rewrite, broken), []

    def fails(*args):
        calls.append(args)
        if len(calls) == (2 if broken == "_drop_partition" else 1):
            raise OSError("lost")
        return real(*args)

    monkeypatch.setattr(rewrite, broken, fails)
    with pytest.raises(OSError):
        rewrite.archive_generation(spark, table, archive, "gen-2")
    if broken == "_overwrite_partitions":
        assert contents(spark, table) == before and not rewrite.exists(spark, archive)
    monkeypatch.undo()
    assert rewrite.archive_generation(spark, table, archive, "gen-2") == 40
    live, kept = contents(spark, table), contents(spark, archive)
    assert {k[1] for k in live} == {"vlm__a"} and sum(live.values()) == 20
    assert Counter(k[:3] for k in kept) + Counter(k[:3] for k in live) == Counter(k[:3] for k in before)
    assert {k[3] for k in kept if k[1] is None} == {"unreadable"}
    assert not rewrite.exists(spark, rewrite.pending(table))
    assert rewrite.archive_generation(spark, table, archive, "gen-2") == 0
    # The same rows again: every place is taken, so nothing moves.
    files.write_snapshot(stored_rows(spark), table)
    with pytest.raises(FileExistsError, match="nothing was moved"):
        rewrite.archive_generation(spark, table, archive, "gen-2")
    assert contents(spark, table) == before and contents(spark, archive) == kept


def test_a_broken_replacement_is_ended_by_the_next_run(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    files.write_snapshot(stored_rows(spark), table)
    before = contents(spark, table)
    fresh = spark.read.parquet(table).where("parser = 'vlm__a'").withColumn("v", F.col("v") + 100)
    real = rewrite._overwrite_partitions
    monkeypatch.setattr(rewrite, "_overwrite_partitions", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        rewrite.replace_partitions(fresh, table, ["parser"])
    assert contents(spark, table) == before
    monkeypatch.setattr(rewrite, "_overwrite_partitions", real)
    assert rewrite.finish_replacement(spark, table, ["parser"])
    now = contents(spark, table)
    assert {k: n for k, n in now.items() if k[1] != "vlm__a"} == {k: n for k, n in before.items() if k[1] != "vlm__a"}
    assert {k[2] for k in now if k[1] == "vlm__a"} == set(range(100, 120))
    assert not rewrite.finish_replacement(spark, table, ["parser"])


def test_a_replacement_broken_between_its_files_is_ended(spark, tmp_path, monkeypatch):
    """Staged files are moved, not written again; some moved and some not is no harm."""
    table = tmp_path / "t"
    files.write_snapshot(stored_rows(spark), str(table))
    before = contents(spark, str(table))
    fresh = spark.read.parquet(str(table)).where("parser = 'ocr b/c' OR parser IS NULL").withColumn("v", F.col("v") + 100).repartition(3)
    monkeypatch.setattr(rewrite, "remove", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        rewrite.replace_partitions(fresh, str(table), ["parser"])
    monkeypatch.undo()
    staged = tmp_path / "t.pending" / "rows"
    place = next(p for p in table.iterdir() if "ocr" in p.name)
    moved = sorted(place.glob("part-*"))
    assert len(moved) == 3 and not list(staged.glob("*/part-*"))
    moved[0].rename(staged / place.name / moved[0].name)
    (place / "part-old.parquet").write_bytes(moved[1].read_bytes())
    assert rewrite.finish_replacement(spark, str(table), ["parser"])
    now = contents(spark, str(table))
    assert now == Counter({(q, p, v if p == "vlm__a" else v + 100, g): n for (q, p, v, g), n in before.items()})
    assert not rewrite.exists(spark, rewrite.pending(str(table)))


def test_stored_answers_are_scored_once_for_counts_and_rewrite(spark, sf, monkeypatch):
    from gradeline.operators import cells
    from gradeline.plans import intake

    calls, real = [], cells.rescore
    monkeypatch.setattr(cells, "rescore", lambda *a: calls.append(a) or real(*a))
    assert intake.rescored_table(spark, sf).count() == 6 and len(calls) == 1
