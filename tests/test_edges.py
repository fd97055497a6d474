"""Inputs that the registered fixtures do not hold: repeated ids, missing boxes, unequal legs."""

import json

import pytest
from pyspark.sql import functions as F

from gradeline.operators import payloads as pay
from gradeline.operators import stats
from gradeline.session import work_folder
from gradeline.sources import files as src


def payloads(spark, *objects):
    texts = [x if isinstance(x, str) else json.dumps(x) for x in objects]
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, payload string")


def test_coco_repeated_category_and_missing_box(spark):
    page = {
        "categories": [{"id": 1, "name": "Text"}, {"id": 1, "name": "Table"}],
        "annotations": [{"id": 5, "category_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 6, "category_id": 1}],
    }
    out = pay.coco_blocks(payloads(spark, page), "payload", ["page_id"]).collect()
    assert [(r.kind, r.bbox.x, r.bbox.h) for r in out] == [("table", 1, 4)]


def test_textract_repeated_block_id(spark):
    page = {"Blocks": [{"BlockType": "LINE", "Id": "a", "Text": "old"}, {"BlockType": "LINE", "Id": "a", "Text": "new"}]}
    assert pay.textract_markdown(payloads(spark, page), "payload").count() == 1


def test_run_blocks_of_two_pages(spark):
    def entry(i, page, order=None, box=True):
        size = {"number": page, "width": 100.4 * page, "height": 200.6} if page < 3 else {"number": page}
        meta = {"page": size, **({} if order is None else {"reading_order": order})}
        at = {"left": 1, "top": 2, "right": 5, "bottom": 9}
        return {"id": str(i), "type": "text", "metadata": meta, **({"bounding_box": at} if box else {})}

    one = [entry(0, 2), entry(1, 1), entry(2, 2, box=False), entry(3, 2), entry(4, 1, 7), entry(5, 3), {"id": "6", "type": "text", "metadata": {"page_number": 1}, "bounding_box": {"left": 0, "top": 0, "right": 1, "bottom": 1}}]
    df = payloads(spark, {"chunks": [{"blocks": one[:2]}, {"blocks": one[2:]}]}, {"chunks": [{"blocks": [entry(0, 1, box=False), {**one[6], "id": "9"}]}]})
    out = pay.run_blocks(df, "payload", ["page_id"]).collect()
    got = [(r.page_id, r.id, r.page_number, r.page_width, r.page_height, r.reading_order) for r in sorted(out, key=lambda r: (r.page_id, r.idx))]
    assert got == [
        (0, "0", 2, 201, 201, 0), (0, "1", 1, 100, 201, 0), (0, "3", 2, 201, 201, 1), (0, "4", 1, 100, 201, 7),
        (0, "5", 3, 0, 0, 0), (0, "6", 1, 100, 201, 2), (1, "9", 1, 100, 201, 0),
    ]


def test_dots_fallbacks(spark):
    box = [0, 0, 10, 10]
    replies = [
        {"note": "see [x]", "things": [{"category": "Table", "bbox": box}]},
        {"layout": [{"category": "", "type": "Table", "bbox": box}]},
        {"layout": [{"category": "Table", "bbox": [], "box": box}]},
    ]
    out = pay.dots_blocks(payloads(spark, *replies), "payload", ["page_id"]).collect()
    assert [(r.page_id, r.kind) for r in sorted(out)] == [(0, "table"), (1, "table"), (2, "table")]


def test_a_null_error_is_an_error(spark):
    rows = [{"qid": "q", "parser": "p", "answer": {}, "error": None}, {"qid": "r", "parser": "p", "answer": {}}]
    out = src.parse_answers(payloads(spark, *rows), "payload")
    assert {r.qid: r.error for r in out.collect()} == {"q": "", "r": None}
    assert [r.qid for r in src.shown_answers(out).collect()] == ["r"]


def outcomes(spark, legs):
    rows = [(leg, f"q{d}", "k", d, "correct" if hit(i) else "incorrect") for leg, docs, hit in legs for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "parser string, qid string, key string, doc string, status string")


def test_a_pair_counts_its_own_documents(spark):
    few, many = [f"d{i}" for i in range(10)], [f"m{i}" for i in range(100)]
    rows = outcomes(spark, [("A", few, lambda i: True), ("B", few, lambda i: False), ("C", many, lambda i: i % 2 == 0)])
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    ci = {r.b: r for r in stats.paired_delta_ci(rows, pairs, iters=300).collect()}
    assert (ci["B"].n_docs, ci["C"].n_docs) == (10, 110)
    assert ci["B"].delta == 1.0 and ci["B"].lo == 1.0
    alone = stats.paired_delta_ci(rows.where("parser <> 'C'"), pairs.where("b = 'B'"), iters=300).first()
    assert (alone.n_docs, alone.lo, alone.hi) == (ci["B"].n_docs, ci["B"].lo, ci["B"].hi)
    v = stats.verdict(F.lit(ci["B"].n_docs), F.lit(ci["B"].lo), F.lit(ci["B"].hi))
    assert spark.range(1).select(v.alias("v")).first().v == "insufficient clusters"


def test_intervals_know_clusters(spark):
    one = outcomes(spark, [("A", [f"d{i % 10}" for i in range(200)], lambda i: i % 10 < 5)])
    own = outcomes(spark, [("A", [f"d{i}" for i in range(200)], lambda i: i % 10 < 5)])
    wide, narrow = (stats.cluster_bootstrap_ci(x, iters=500).first() for x in (one, own))
    assert wide.lo < 0.5 < wide.hi and narrow.lo < 0.5 < narrow.hi
    assert wide.hi - wide.lo > 2 * (narrow.hi - narrow.lo)
    assert (wide.n_docs, narrow.n_docs) == (10, 200)


def test_a_cluster_must_name_its_folder(spark):
    class Other:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        work_folder(Other, "x")
