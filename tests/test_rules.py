"""Rules that the derived tables do not reach, as small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from gradeline.functions import typing as ty
from gradeline.operators import cells, cost, layout, metrics, quality, reports, stats
from gradeline.sources import dimensions, files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "parser string, qid string, key string, doc string, status string")


def leg(name, docs, per_doc, right):
    return [
        (name, f"q{d}", f"k{i}", f"d{d}", "correct" if right(d, i) else "incorrect")
        for d in range(docs) for i in range(per_doc)
    ]


def test_error_beats_answer_and_absent_null_is_wrong(spark):
    bank = spark.sql("""SELECT 'q1' qid, 'd1' doc, 'x' domain, array('blank_field') capabilities,
      array(named_struct('key','a','gold_kind','null','gold_true',cast(null as boolean)),
            named_struct('key','b','gold_kind','num','gold_true',cast(null as boolean))) fields""")
    def status(**row):
        base = dict(qid="q1", parser="p", error=None, has_answer=True, is_object=True,
                    field_matches={"a": True, "b": True}, null_keys=["a"])
        df = spark.createDataFrame(
            [tuple({**base, **row}[k] for k in base)],
            "qid string, parser string, error string, has_answer boolean, is_object boolean, "
            "field_matches map<string,boolean>, null_keys array<string>")
        return {r.key: r.status for r in cells.field_outcomes(bank, df, ["p"]).collect()}
    assert status() == {"a": "correct", "b": "correct"}
    assert status(null_keys=[]) == {"a": "incorrect", "b": "correct"}
    assert status(error="late failure") == {"a": "error", "b": "error"}
    assert status(is_object=False) == {"a": "error", "b": "error"}
    assert status(field_matches=None) == {"a": "correct", "b": "incorrect"}


def test_checkbox_metrics_refuse_other_golds(spark):
    df = spark.sql("SELECT 'p' parser, 'num' gold_kind, true gold_true, 'correct' status")
    with pytest.raises(Exception, match="boolean gold"):
        metrics.checkbox_metrics(df, ["parser"]).collect()


def test_bootstrap_properties(spark):
    alternating = outcomes(spark, leg("a", 40, 5, lambda d, i: d % 2 == 0))
    r = stats.cluster_bootstrap_ci(alternating, iters=400).first()
    assert r.lo < 0.5 < r.hi and r.acc == 0.5 and r.n_docs == 40
    again = stats.cluster_bootstrap_ci(alternating, iters=400).first()
    assert (again.lo, again.hi) == (r.lo, r.hi)
    wide = stats.cluster_bootstrap_ci(alternating, iters=400, alpha=0.01).first()
    assert wide.lo <= r.lo and wide.hi >= r.hi
    clustered = stats.cluster_bootstrap_ci(
        outcomes(spark, leg("a", 10, 10, lambda d, i: d % 2 == 0)), iters=400).first()
    free = stats.cluster_bootstrap_ci(
        outcomes(spark, leg("a", 100, 1, lambda d, i: d % 2 == 0)), iters=400).first()
    assert clustered.hi - clustered.lo > free.hi - free.lo
    for bad in ({"iters": 0}, {"alpha": 0.0}, {"alpha": 1.0}):
        with pytest.raises(ValueError):
            stats.cluster_bootstrap_ci(alternating, **bad)


def test_paired_verdicts(spark):
    rows = outcomes(spark, leg("a", 30, 3, lambda d, i: True) + leg("b", 30, 3, lambda d, i: d % 2)
                    + leg("c", 30, 3, lambda d, i: d % 2))
    legs = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")], "parser string, section string")
    got = {(r.a, r.b): r.verdict
           for r in stats.pairwise_separability(rows, legs, iters=300).collect()}
    assert got == {("a", "b"): "a ahead", ("a", "c"): "a ahead", ("b", "c"): "not separable"}
    few = outcomes(spark, leg("a", 5, 3, lambda d, i: True) + leg("b", 5, 3, lambda d, i: False))
    r = stats.pairwise_separability(few, legs, iters=50).first()
    assert r.verdict == "insufficient clusters"


def test_mcnemar_values(spark):
    df = spark.createDataFrame([(27, 14), (25, 1), (0, 0), (5, 5), (4000, 4100)], "b long, c long")
    p = [r.p for r in df.select(stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()]
    assert p[0] == pytest.approx(0.0596, abs=5e-4)
    assert p[1] == pytest.approx(8.05e-7, rel=1e-2)
    assert p[2] is None and p[3] == 1.0
    assert 0.2 < p[4] < 0.3


def test_dates_and_hints(spark):
    say = lambda t: one(spark, ty.iso_date(F.lit(t)))
    assert say("13/02/2024") == "2024-02-13"
    assert say("02/13/2024") == "2024-02-13"
    assert say("1/2/69") == "1969-01-02" and say("1/2/68") == "2068-01-02"
    assert say("Sept 5, 2023;") == "2023-09-05"
    assert say("30/02/2024") is None and say("soon") is None
    hint = lambda t: one(spark, ty.placeholder_hint(F.lit(t)))
    assert hint("A | a | b") == "one of: A | b"
    assert hint("null | YEAR") == "integer | null"


def test_coercion_edges(spark):
    def value(raw, hint):
        v = ty.coerce_value(F.lit(raw), F.lit(hint))
        return one(spark, F.coalesce(F.to_json(v), F.lit("null")))
    assert value("+1,200%", "integer") == "1200"
    assert value("12.5", "integer") == "12.5"
    assert value("-", "number") == "null" and value("-", "string") == '"-"'
    assert value("N/A", "boolean") == "null" and value("n/a", "string") == '"n/a"'
    assert value("maybe", "boolean") == '"maybe"'
    assert value(" a   b ", "string") == '"a b"'


def test_local_leg_has_latency_but_no_cost(spark):
    rows = spark.sql("SELECT 'p' parser, 2.0D latency_sec, parse_json('{\"cost\": 1.5}') usage")
    entries = spark.sql("SELECT 'p' parser, true local, cast(null as double) input_per_mtok, "
                        "cast(null as double) output_per_mtok")
    r = cost.direct_cost_latency(rows, entries).first()
    assert r.median_latency == 2.0 and r.cost_usd is None


def test_pareto_ties(spark):
    points = spark.createDataFrame(
        [("a", 1.0, .6), ("b", 2.0, .8), ("c", 3.0, .9), ("d", 4.0, .7), ("e", 2.0, .8),
         ("f", 2.0, .7)], "label string, x double, y double")
    on = {r.label for r in reports.pareto(points, 4).where("on_frontier").collect()}
    assert on == {"a", "b", "c", "e"}


def test_duplicate_registry_ids_stop(spark):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    assert dimensions.registry(a).count() == 2
    with pytest.raises(Exception, match="duplicate registry ids: x"):
        dimensions.registry(a, spark.createDataFrame([("x",)], "id string")).collect()


def test_bucket_definitions_are_checked(spark):
    with pytest.raises(ValueError):
        dimensions.capability_buckets(spark, [{"name": "a"}])
    with pytest.raises(ValueError):
        dimensions.capability_buckets(spark, [("a", "tag", "")])


def test_bank_without_gold_stops(spark):
    texts = spark.createDataFrame([('{"items": [{"question_id": "q"}]}',)], "value string")
    with pytest.raises(Exception, match="without gold"):
        files.parse_bank(texts).collect()


def test_bank_and_answer_files(spark, tmp_path):
    (tmp_path / "bank.json").write_text(
        '{"items": [{"question_id": "q1", "source_file": "d", "gold_dict": {"amount": 100},'
        ' "response_format": "Return exactly: amount=<number>"}]}')
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "wrong_name.json").write_text('{"qid": "q1", "parser": "p", "answer": {"amount": "$100"}}')
    (cache / "null.json").write_text('{"qid": "q1", "parser": "n", "answer": null}')
    (cache / "torn.json").write_text('{"qid": "q1", "par')
    (cache / "keyless.json").write_text('{"qid": "q1", "answer": {}}')
    bank = files.load_bank(spark, str(tmp_path / "bank.json"))
    answers = files.load_answers(spark, str(cache))
    assert {(r.parser, r.has_answer, r.is_object) for r in answers.collect()} == {
        ("p", True, True), ("n", True, False)}
    got = {r.parser: r.match for r in cells.score_cells(bank, answers).collect()}
    assert got == {"p": True, "n": False}


def test_stale_and_drift(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01T00:00:00"), ("a", "2024-01-09T00:00:00"), ("b", "2024-01-01"),
         ("c", "2024-01-01"), ("c", "x"), ("c", "2024-03-01")], "parser string, retrieved_at string")
    assert [r.parser for r in quality.stale_windows(rows).collect()] == ["a"]


def test_adjusted_blocks_join_text(spark):
    schema = ("page_id int, processor string, idx int, kind string, bbox struct<x:int,y:int,w:int,h:int>,"
              "confidence double, text string, ignore boolean")
    pred = spark.createDataFrame(
        [(1, "p", 0, "text", (0, 0, 100, 45), 1.0, "one", False),
         (1, "p", 1, "text", (0, 50, 100, 45), 1.0, "two", True)], schema)
    gt = spark.createDataFrame([(1, None, 0, "text", (0, 0, 100, 100), 1.0, None, False)], schema)
    dims = spark.createDataFrame([(1, 1000, 1000)], "page_id int, width int, height int")
    rows = layout.recover_matches(layout.page_pairs(gt, pred, ["p"], dims))
    r = layout.adjusted_blocks(rows).where("side = 'pred'").collect()
    assert len(r) == 1 and r[0].text == "one\ntwo" and r[0].ignore and r[0].bbox.h == 95
    board = layout.recovery_sums(layout.recovery_counts(rows), ["processor"]).first()
    assert (board.strict_tp, board.adjusted_tp, board.adjusted_fp, board.adjusted_fn) == (0, 1, 0, 0)


def test_metric_plans_hold_no_python(spark, sf):
    import __spark_entry__ as e

    for name in ("A02_metric_block", "A05_system_summary", "B01_cluster_bootstrap", "R09_pareto"):
        plan = e.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan and "MapInPandas" not in plan
