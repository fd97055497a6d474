"""Layout detection metrics: matching, strict and adjusted F1, confusion, AP.

Blocks are rows ``page_id, processor, idx, kind, bbox struct<x,y,w,h>, confidence, text, ignore``;
ground truth has no processor. A page is the unit of joint work and is bounded by what is printed
on it; one shuffle brings both sides of a page together for all processors at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from gradeline.functions import geometry as geo
from gradeline.functions import pages as pg
from gradeline.functions.prefix import prefix_sums
from gradeline.functions.ratio import f1, long_sum, precision, recall, share
from gradeline.session import written

# Least overlap of a match, gap of adjacent boxes as a share of the page, AP thresholds.
IOU = 0.5
GAP = 0.02
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
PAIRS = pa.list_(pa.struct([("p", pa.int32()), ("g", pa.int32())]))
BOX = pa.struct([(c, pa.int32()) for c in "xywh"])
RECORDS = pa.list_(pa.struct([
    ("sources", pa.list_(pa.int32())), ("target", pa.int32()), ("before", pa.float64()),
    ("after", pa.float64()), ("bbox", BOX),
]))
CLASS_COUNTS = ("tp", "n_pred", "n_gt", "splits", "split_sources", "merges", "merge_sources")
CLASSES = pa.list_(pa.struct([("class", pa.string()), *[(c, pa.int64()) for c in CLASS_COUNTS]]))
#: What one crossing of the page kernel can return.
RESULTS = {"matched": PAIRS, "blind": PAIRS, "splits": RECORDS, "merges": RECORDS, "classes": CLASSES}


def _block() -> Column:
    return F.struct("idx", "kind", "bbox", "confidence", "text", "ignore")


def page_pairs(
    truth: DataFrame, predictions: DataFrame, processors: list[str], pages: DataFrame | None = None
) -> DataFrame:
    """One row per (page, processor) with arrays ``pred`` and ``gt`` in index order.

    Both sides are dealt out by page once; what a page's processors found is gathered there. A
    processor that found nothing on a page still gets its row. ``pages`` adds width and height.
    """
    g = truth.select("page_id", F.lit(None).cast("string").alias("processor"), _block().alias("b"))
    p = predictions.select("page_id", "processor", _block().alias("b"))
    # Dealt by page, so that neither grouping below moves rows again.
    dealt = g.unionByName(p).repartition("page_id")
    lists = dealt.groupBy("page_id", "processor").agg(F.array_sort(F.collect_list("b")).alias("b"))
    found = F.col("processor").isNotNull()
    held = lists.groupBy("page_id").agg(
        F.any_value(F.when(~found, F.col("b")), True).alias("gt"),
        F.map_from_entries(F.collect_list(F.when(found, F.struct("processor", "b")))).alias("_all"),
    )
    none = F.array().cast(lists.schema["b"].dataType)
    rows = held.withColumn("processor", F.explode(F.array(*[F.lit(x) for x in processors])))
    rows = rows.select(
        "page_id", F.coalesce("gt", none).alias("gt"), "processor",
        F.coalesce(F.try_element_at("_all", F.col("processor")), none).alias("pred"),
    )
    if pages is not None:
        rows = rows.join(pages.select("page_id", "width", "height"), "page_id", "left")
    return rows


def _flat(side: str) -> list[Column]:
    return [F.col(f"{side}.{c}") for c in ("kind", "bbox.x", "bbox.y", "bbox.w", "bbox.h")]


def _batch(columns: list[pa.Array]) -> tuple[pg.Batch, pa.Array]:
    """Both sides of an Arrow batch of pages as flat arrays, and the names of the kinds."""
    sides = columns[:5], columns[5:10]
    kinds = pa.concat_arrays([c[0].flatten().cast(pa.string()) for c in sides])
    kinds = pc.dictionary_encode(kinds, null_encoding="encode")
    codes, made, at = kinds.indices.to_numpy(), [], 0
    for kind, *box in sides:
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(kind).to_numpy())])
        flat = [c.flatten() for c in box]
        numbers = [pc.fill_null(c, 0).to_numpy().astype(np.float64) for c in flat]
        valid = flat[0].is_valid().to_numpy(zero_copy_only=False)
        made.append(pg.Side(starts, pg.Boxes(*numbers, codes[at : at + len(valid)], valid)))
        at += len(valid)
    return pg.Batch(*made), kinds.dictionary


def _listed(page: np.ndarray, n_pages: int, kind: pa.DataType, columns: list) -> pa.Array:
    """Items with their pages (in order) as one list per page."""
    fields = list(kind.value_type)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)]
    offsets = np.searchsorted(page, np.arange(n_pages + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, fields=fields))


def _records(found: pg.Merges, n_pages: int) -> pa.Array:
    """Merges with their pages as one list of records per page."""
    offsets = np.concatenate([[0], np.cumsum(found.n_sources)]).astype(np.int32)
    sources = pa.ListArray.from_arrays(offsets, pa.array(found.sources[found.sources >= 0], pa.int32()))
    bbox = pa.StructArray.from_arrays([pa.array(found.box[:, c].astype(np.int32)) for c in range(4)], fields=list(BOX))
    return _listed(found.key, n_pages, RECORDS, [sources, found.target, found.before, found.after, bbox])


def page_results(
    pairs: DataFrame, *wanted: str, threshold: float = IOU, gap: float | None = None, typed: bool = True
) -> DataFrame:
    """Add results of matching inside the pages, all from one pass through the page kernel.

    ``matched``: kept pairs (positions in ``pred`` and ``gt``) of the optimal assignment, with a
    penalty on unlike kinds if ``typed``; ``blind``: the same without it; ``splits`` and ``merges``:
    predictions merged for a truth that ``matched`` misses, and the reverse; ``classes``: counts of
    a matching within each kind, with its merges if ``gap`` is given. ``gap`` is the widest gap of
    adjacent boxes as a share of the page. Only flat lists of kinds and numbers travel.
    """
    with_records = "splits" in wanted or "merges" in wanted
    if with_records and gap is None:
        gap = GAP
    result = pa.struct([(w, RESULTS[w]) for w in wanted])

    def run(*columns: pa.Array) -> pa.Array:
        batch, names = _batch(columns[:10])
        n = batch.n_pages
        reach = columns[10].to_numpy(zero_copy_only=False)
        out = {}
        if "matched" in wanted or with_records:
            i, j = batch.pairs(threshold, typed)
            page = batch.page_p[i]
            if "matched" in wanted:
                out["matched"] = _listed(page, n, PAIRS, [i - batch.p.starts[page], j - batch.g.starts[page]])
            if with_records:
                splits, merges = batch.merges(i, j, threshold, reach)
                out |= {"splits": _records(splits, n), "merges": _records(merges, n)}
        if "blind" in wanted:
            i, j = batch.pairs(threshold, False)
            page = batch.page_p[i]
            out["blind"] = _listed(page, n, PAIRS, [i - batch.p.starts[page], j - batch.g.starts[page]])
        if "classes" in wanted:
            found = batch.by_class(threshold, reach if gap is not None else None)
            none = np.zeros(len(found["page"]), dtype=np.int64)
            counted = [found.get(c, none) for c in CLASS_COUNTS]
            out["classes"] = _listed(found["page"], n, CLASSES, [names.take(pa.array(found["kind"])), *counted])
        return pa.StructArray.from_arrays([out[w] for w in wanted], fields=list(result))

    kernel = F.arrow_udf(run, from_arrow_type(result))
    reach = F.lit(0.0)
    if gap is not None:
        reach = F.greatest(F.coalesce("width", F.lit(1)), F.coalesce("height", F.lit(1))) * F.lit(gap)
    rows = pairs.withColumn("_k", kernel(*_flat("pred"), *_flat("gt"), reach.cast("double")))
    return rows.select(*pairs.columns, *[F.col(f"_k.{w}").alias(w) for w in wanted])


def match_blocks(pairs: DataFrame, *, threshold: float = IOU, typed: bool = True) -> DataFrame:
    """Add ``matched``: the kept pairs of the optimal assignment."""
    return page_results(pairs, "matched", threshold=threshold, typed=typed)


def recover_matches(
    pairs: DataFrame, *, threshold: float = IOU, gap: float = GAP, typed: bool = True
) -> DataFrame:
    """Add pairs plus merge records: ``splits`` (predictions for a truth), ``merges`` (reverse)."""
    return page_results(pairs, "matched", "splits", "merges", threshold=threshold, gap=gap, typed=typed)


def same_kind(m: Column) -> Column:
    """The two blocks of a matched pair are of one kind."""
    return F.element_at(F.col("pred"), m["p"] + 1)["kind"] == F.element_at(
        F.col("gt"), m["g"] + 1
    )["kind"]


def counts(tp: Column, n_pred: Column, n_gt: Column) -> dict[str, Column]:
    """tp, fp and fn when every block outside a true positive is an error of its side."""
    return {
        "tp": tp.cast("bigint"),
        "fp": (n_pred - tp).cast("bigint"),
        "fn": (n_gt - tp).cast("bigint"),
    }


def with_prf(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns(
        {"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)}
    )


def strict_counts(matched: DataFrame, *, typed: bool = True) -> DataFrame:
    """tp/fp/fn per row; a pair of the wrong type is an error on both sides unless tolerated."""
    hits = F.filter("matched", same_kind) if typed else F.col("matched")
    return matched.withColumns(counts(F.size(hits), F.size("pred"), F.size("gt")))


def pooled(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro scores: sums first, ratios after."""
    return with_prf(
        rows.groupBy(*by).agg(*[long_sum(F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    )


def strict_f1(pairs: DataFrame, by: list[str], *, typed: bool = True) -> DataFrame:
    return pooled(strict_counts(match_blocks(pairs, typed=typed), typed=typed), by)


def class_rows(scored: DataFrame, by: list[str]) -> DataFrame:
    """One row per page and class from the ``classes`` of :func:`page_results`."""
    return scored.select(*by, F.inline("classes"))


def per_class_f1(pairs: DataFrame, by: list[str]) -> DataFrame:
    rows = class_rows(page_results(pairs, "classes"), by)
    tp, n_pred, n_gt = F.col("tp"), F.col("n_pred"), F.col("n_gt")
    return pooled(rows.withColumns(counts(tp, n_pred, n_gt)), [*by, "class"])


def recovery_counts(recovered: DataFrame) -> DataFrame:
    """Strict and adjusted counts with the error breakdown, per row.

    Strict here keeps pairs of the wrong type; a recovered group counts one hit and takes all its
    blocks out of the errors.
    """
    n_pair, n_split, n_merge = F.size("matched"), F.size("splits"), F.size("merges")
    taken = lambda c: F.aggregate(
        c, F.lit(0), lambda acc, r: acc + F.size(r["sources"])
    )
    used_p = n_pair + taken("splits") + n_merge
    used_g = n_pair + n_split + taken("merges")
    n_p, n_g = F.size("pred"), F.size("gt")
    return recovered.withColumns(
        {
            "strict_tp": n_pair, "strict_fp": n_p - n_pair, "strict_fn": n_g - n_pair,
            "adjusted_tp": n_pair + n_split + n_merge,
            "adjusted_fp": n_p - used_p, "adjusted_fn": n_g - used_g,
            "splits_resolved": n_split, "merges_resolved": n_merge,
            "misclassified": F.size(F.filter("matched", lambda m: ~same_kind(m))), "n_gt": n_g,
        }
    )


def class_recovery_counts(rows: DataFrame) -> DataFrame:
    """:func:`recovery_counts` of the rows of :func:`class_rows`."""
    tp, n_p, n_g = F.col("tp"), F.col("n_pred"), F.col("n_gt")
    splits, merges = F.col("splits"), F.col("merges")
    return rows.withColumns(
        {
            "strict_tp": tp, "strict_fp": n_p - tp, "strict_fn": n_g - tp,
            "adjusted_tp": tp + splits + merges,
            "adjusted_fp": n_p - tp - F.col("split_sources") - merges,
            "adjusted_fn": n_g - tp - splits - F.col("merge_sources"),
            "splits_resolved": splits, "merges_resolved": merges, "misclassified": F.lit(0),
        }
    )


RECOVERY = [
    "strict_tp", "strict_fp", "strict_fn", "adjusted_tp", "adjusted_fp", "adjusted_fn",
    "splits_resolved", "merges_resolved", "misclassified",
]


def recovery_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = rows.groupBy(*by).agg(
        *[long_sum(F.col(c)).alias(c) for c in RECOVERY], F.count("*").alias("n_pages"),
        long_sum(F.col("n_gt")).alias("n_gt"),
    )
    add = {}
    for v in ("strict", "adjusted"):
        tp, fp, fn = (F.col(f"{v}_{c}") for c in ("tp", "fp", "fn"))
        add |= {
            f"{v}_precision": precision(tp, fp), f"{v}_recall": recall(tp, fn),
            f"{v}_f1": f1(tp, fp, fn),
        }
    return sums.withColumns(add)


def data_set_score(pairs: DataFrame, by: list[str], **options) -> dict[str, DataFrame]:
    """Micro totals, the per-class table, and macro means over classes that have ground truth."""
    options = {"gap": GAP} | options
    # Two passes of the kernel, as either table is read without the other and neither needs its results.
    micro = recovery_sums(recovery_counts(page_results(pairs, "matched", "splits", "merges", **options)), by)
    scored = page_results(pairs, "classes", **options)
    classes = recovery_sums(class_recovery_counts(class_rows(scored, by)), [*by, "class"]).where("n_gt > 0")
    macro = classes.groupBy(*by).agg(
        *[
            F.avg(f"{v}_{m}").alias(f"{v}_macro_{m}")
            for v in ("strict", "adjusted") for m in ("precision", "recall", "f1")
        ],
        F.count("*").alias("n_classes"),
    )
    return {"micro": micro, "classes": classes, "macro": macro}


def adjusted_blocks(recovered: DataFrame) -> DataFrame:
    """Block lists after recovery: merged blocks first, then the untouched ones.

    A merged block has the union box, the type of its first source, joined text, and is ignored
    when any source is.
    """

    def merged(side: str, records: str) -> Column:
        def one(r: Column) -> Column:
            parts = F.transform(r["sources"], lambda i: F.element_at(F.col(side), i + 1))
            texts = F.filter(
                F.transform(parts, lambda b: b["text"]), lambda t: F.coalesce(t != "", F.lit(False))
            )
            return F.struct(
                parts[0]["kind"].alias("kind"), r["bbox"].alias("bbox"),
                F.when(F.size(texts) > 0, F.array_join(texts, "\n")).alias("text"),
                F.exists(parts, lambda b: F.coalesce(b["ignore"], F.lit(False))).alias("ignore"),
                F.lit(True).alias("merged"),
            )

        gone = F.flatten(F.transform(records, lambda r: r["sources"]))
        rest = F.filter(F.col(side), lambda b, i: ~F.array_contains(gone, i))
        keep = F.transform(
            rest,
            lambda b: F.struct(
                b["kind"].alias("kind"), b["bbox"].alias("bbox"), b["text"].alias("text"),
                b["ignore"].alias("ignore"), F.lit(False).alias("merged"),
            ),
        )
        return F.concat(F.transform(F.col(records), one), keep)

    side = lambda name, blocks: F.transform(
        blocks, lambda b: F.struct(F.lit(name).alias("side"), b.alias("block"))
    )
    both = F.concat(side("pred", merged("pred", "splits")), side("gt", merged("gt", "merges")))
    return recovered.select("page_id", "processor", F.inline(both)).select(
        "page_id", "processor", "side", "block.*"
    )


def structural_errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Misses, hallucinations and misclassifications under type-blind matching."""
    m = match_blocks(pairs, typed=False)
    return m.groupBy(*by).agg(
        long_sum(F.size("gt") - F.size("matched")).alias("misses"),
        long_sum(F.size("pred") - F.size("matched")).alias("hallucinations"),
        long_sum(F.size(F.filter("matched", lambda x: ~same_kind(x)))).alias("misclassifications"),
    )


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(predicted class, true class) counts of wrong-type pairs."""
    m = match_blocks(pairs, typed=False).select(
        *by,
        F.explode(
            F.transform(
                F.filter("matched", lambda x: ~same_kind(x)),
                lambda x: F.struct(
                    F.element_at(F.col("pred"), x["p"] + 1)["kind"].alias("pred_type"),
                    F.element_at(F.col("gt"), x["g"] + 1)["kind"].alias("gt_type"),
                ),
            )
        ).alias("c"),
    )
    return m.groupBy(*by, "c.pred_type", "c.gt_type").agg(F.count("*").alias("n"))


def top_confusions(conf: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """Leading confusions, ties by class names."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "pred_type", "gt_type")
    return conf.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def iou_pairs(a: DataFrame, b: DataFrame, cell: int = 512) -> DataFrame:
    """Overlapping (prediction, truth) pairs of a page with their IoU.

    Boxes meet in the grid cells they touch, so a dense page does not emit all its pairs; the cell
    that holds the overlap's top-left corner reports a pair, once.
    """
    left = a.select(
        "page_id", "processor", F.col("idx").alias("p_idx"), F.col("bbox").alias("pb"),
        F.explode(geo.grid_cells(F.col("bbox"), cell)).alias("cell"),
    )
    right = b.select(
        "page_id", F.col("idx").alias("g_idx"), F.col("bbox").alias("gb"),
        F.explode(geo.grid_cells(F.col("bbox"), cell)).alias("cell"),
    )
    rows = left.join(right, ["page_id", "cell"])
    pb, gb = F.col("pb"), F.col("gb")
    corner = F.struct(
        F.floor(F.greatest(pb["x"], gb["x"]) / F.lit(float(cell))).cast("int").alias("cx"),
        F.floor(F.greatest(pb["y"], gb["y"]) / F.lit(float(cell))).cast("int").alias("cy"),
    )
    return rows.where((F.col("cell") == corner) & (geo.intersection_area(pb, gb) > 0)).select(
        "page_id", "processor", "p_idx", "g_idx", geo.iou(pb, gb).alias("iou")
    )


def adjacent_pairs(blocks: DataFrame, pages: DataFrame, gap: float = GAP, cell: int = 512):
    """Adjacent blocks of one type on a page, each pair once."""
    dims = pages.select("page_id", (F.greatest("width", "height") * F.lit(gap)).alias("reach"))
    rows = blocks.join(dims, "page_id").withColumn(
        "cell", F.explode(geo.grid_cells(F.col("bbox"), cell, F.col("reach")))
    )
    a = rows.select("page_id", "processor", "kind", "cell", "reach",
                    F.col("idx").alias("a_idx"), F.col("bbox").alias("ab"))
    b = rows.select("page_id", "processor", "kind", "cell",
                    F.col("idx").alias("b_idx"), F.col("bbox").alias("bb"))
    met = a.join(b, ["page_id", "processor", "kind", "cell"]).where("a_idx < b_idx")
    near = met.where(geo.adjacent(F.col("ab"), F.col("bb"), F.col("reach")))
    return near.select("page_id", "processor", "kind", "a_idx", "b_idx").distinct()


def adjacent_groups(blocks: DataFrame, pages: DataFrame, gap: float = GAP) -> DataFrame:
    """Groups of adjacent blocks of one type on a page: each block with the smallest idx of its group.

    Within the row of a (page, processor, type): every block starts with those it touches, and a round
    joins their lists, so chains of twice the length are covered each time and log2(n) rounds suffice.
    """
    keys = ["page_id", "processor", "kind"]
    dims = pages.select("page_id", (F.greatest("width", "height") * F.lit(gap)).alias("_reach"))
    usable = blocks.where(F.col("bbox").isNotNull())
    held = usable.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "bbox"))).alias("_b")).join(dims, "page_id")
    box = lambda i: F.get("_b", i)["bbox"]
    at = F.sequence(F.lit(0), F.size("_b") - 1)
    near = F.transform(at, lambda i: F.filter(at, lambda j: (i == j) | geo.adjacent(box(i), box(j), F.col("_reach"))))
    held = held.withColumn("_near", near)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_b").cast("double"))).cast("int"))
    reached = F.aggregate(
        rounds, F.col("_near"),
        lambda lists, _: F.transform(lists, lambda one: F.array_distinct(F.flatten(F.transform(one, lambda j: F.get(lists, j))))),
    )
    groups = F.zip_with("_b", reached, lambda b, one: F.struct(
        b["idx"].alias("idx"), F.get("_b", F.array_min(one))["idx"].alias("group"), F.size(one).alias("size")))
    return held.select(*keys, F.inline(groups))


def ignore_blocks(blocks: DataFrame, mode: str, ignored: list[str]) -> DataFrame:
    """``exclude_matching`` drops ignored types, ``include_exclude_metrics`` flags them."""
    hit = F.col("kind").isin(ignored)
    if mode == "disabled":
        return blocks
    if mode == "exclude_matching":
        return blocks.where(~hit)
    if mode == "include_exclude_metrics":
        return blocks.withColumn("ignore", F.coalesce("ignore", F.lit(False)) | hit)
    raise ValueError(f"unknown ignore mode {mode!r}")


def ignore_in_pages(pairs: DataFrame, mode: str, ignored: list[str]) -> DataFrame:
    """:func:`ignore_blocks` of both sides of the rows of :func:`page_pairs`."""
    hit = lambda b: b["kind"].isin(ignored)
    if mode == "disabled":
        return pairs
    if mode == "exclude_matching":
        return pairs.withColumns({c: F.filter(c, lambda b: ~hit(b)) for c in ("pred", "gt")})
    if mode == "include_exclude_metrics":
        flagged = lambda b: b.withField("ignore", F.coalesce(b["ignore"], F.lit(False)) | hit(b))
        return pairs.withColumns({c: F.transform(c, flagged) for c in ("pred", "gt")})
    raise ValueError(f"unknown ignore mode {mode!r}")


def ignored_counts(matched: DataFrame) -> DataFrame:
    """tp/fp/fn without ignored blocks: an ignored pair or leftover counts on neither side."""
    flag = lambda side, i: F.coalesce(
        F.element_at(F.col(side), i + 1)["ignore"], F.lit(False)
    )
    kept = F.filter("matched", lambda m: ~(flag("pred", m["p"]) | flag("gt", m["g"])))
    alone = lambda side, f: F.filter(
        F.col(side),
        lambda b, i: ~F.coalesce(b["ignore"], F.lit(False))
        & ~F.exists("matched", lambda m: m[f] == i),
    )
    return matched.withColumns(
        {
            "tp": F.size(kept).cast("bigint"),
            "fp": F.size(alone("pred", "p")).cast("bigint"),
            "fn": F.size(alone("gt", "g")).cast("bigint"),
        }
    )


def greedy_hits(pairs: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Per prediction an array of hits, one flag per IoU threshold, matched within its page."""
    def run(*columns: pa.Array) -> pa.Array:
        batch, _ = _batch(columns[:10])
        hits = batch.hits(columns[10].flatten().to_numpy(zero_copy_only=False).astype(np.float64), thresholds)
        inner = pa.ListArray.from_arrays(np.arange(len(hits) + 1, dtype=np.int32) * len(thresholds), pa.array(hits.ravel()))
        return pa.ListArray.from_arrays(batch.p.starts.astype(np.int32), inner)

    kernel = F.arrow_udf(run, "array<array<boolean>>")
    rows = pairs.where(F.size("pred") > 0).withColumn(
        "hits", kernel(*_flat("pred"), *_flat("gt"), F.col("pred.confidence").cast("array<double>"))
    )
    return rows.select("page_id", "processor", F.inline(F.arrays_zip("pred", "hits"))).select(
        "page_id", "processor", F.col("pred.kind").alias("class"), F.col("pred.idx").cast("int").alias("idx"),
        F.col("pred.confidence").cast("double").alias("confidence"), "hits",
    )


def greedy_flags(pairs: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """:func:`greedy_hits` with one row per (prediction, threshold)."""
    limits = F.array(*[F.lit(t) for t in thresholds])
    return greedy_hits(pairs, thresholds).select(
        "page_id", "processor", "class", "idx", "confidence",
        F.inline(F.arrays_zip(limits.alias("threshold"), F.col("hits").alias("hit"))),
    )


def average_precision(
    hits: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS
) -> DataFrame:
    """11-point interpolated AP per (processor, class, threshold), from :func:`greedy_hits`.

    Predictions are walked by falling confidence, ties by page and index; the walk is the same for
    every threshold, so one row carries all of them until the sums are done. The walk is cut at
    quantiles of that order, so a class whose predictions all carry one confidence spreads out too.
    A class without truth or without predictions scores 0.
    """
    group = ["processor", "class"]
    n = len(thresholds)
    # Written, as the cut points, the walk and the names read them, and each would match the pages again.
    hits = written(hits, "hits")
    rows = hits.select(
        *group, "page_id", "idx", "confidence", F.lit(1).alias("one"),
        *[F.col("hits")[i].cast("int").alias(f"h{i}") for i in range(n)],
    )
    sums = {"cn": "one"} | {f"c{i}": f"h{i}" for i in range(n)}
    walked = prefix_sums(rows, group, [F.desc("confidence"), "page_id", "idx"], sums)
    n_gt = truth.groupBy(F.col("kind").alias("class")).agg(F.count("*").alias("n_gt"))
    steps = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("ctp"))
        for i, t in enumerate(thresholds)
    ])
    curve = walked.join(n_gt, "class").select(*group, "n_gt", "cn", F.inline(steps)).select(
        *group, "threshold", (F.col("ctp") / F.col("n_gt")).alias("recall"),
        (F.col("ctp") / F.col("cn")).alias("precision"),
    )
    group = [*group, "threshold"]
    points = [i * 0.1 for i in range(11)]
    best = curve.groupBy(*group).agg(
        *[F.max(F.when(F.col("recall") >= t, F.col("precision"))).alias(f"_{i}")
          for i, t in enumerate(points)]
    )
    total = sum((F.coalesce(F.col(f"_{i}"), F.lit(0.0)) for i in range(11)), F.lit(0.0))
    scored = best.select(*group, (total / 11).alias("ap"))
    # Every class seen on either side, for every processor and threshold.
    classes = hits.select("class").unionByName(n_gt.select("class"))
    names = classes.agg(F.collect_set("class")).scalar()
    every = (
        hits.select("processor").distinct()
        .withColumn("class", F.explode(names))
        .withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    )
    return every.join(scored, group, "left").join(n_gt, "class", "left").select(
        *group, F.coalesce("ap", F.lit(0.0)).alias("ap"),
        F.coalesce("n_gt", F.lit(0)).alias("n_gt"),
    )


def mean_ap(ap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-class mean over thresholds, and the macro mean over classes that have truth."""
    per_class = ap.groupBy("processor", "class").agg(
        F.avg("ap").alias("ap"),
        F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("ap50"),
        F.max(F.when(F.col("threshold") == 0.75, F.col("ap"))).alias("ap75"),
    )
    macro = ap.where("n_gt > 0").groupBy("processor").agg(
        F.avg("ap").alias("map"),
        F.avg(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("map50"),
        F.avg(F.when(F.col("threshold") == 0.75, F.col("ap"))).alias("map75"),
    )
    return per_class, macro


def confidence_present(pred: Column) -> Column:
    """More than one confidence, or one that is not 1.0; an empty list counts as present."""
    values = F.array_distinct(F.transform(pred, lambda b: b["confidence"]))
    return ~((F.size(values) == 1) & F.coalesce(F.try_element_at(values, F.lit(1)) == 1.0,
                                                F.lit(False)))


SCORERS = ("f1", "adjacency")


def _prf(tp: Column, fp: Column, fn: Column) -> Column:
    tp, fp, fn = (c.cast("bigint") for c in (tp, fp, fn))
    return F.struct(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision(tp, fp).alias("precision"),
        recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"),
    )


def evaluate_cells(pairs: DataFrame, scorers: tuple[str, ...] = ("f1",)) -> DataFrame:
    """Per (page, processor) and scorer the whole result of a cell, from one pass of the page kernel.

    ``strict`` and ``adjusted`` are structs of tp, fp, fn, precision, recall and f1, ``per_class`` a
    map of such structs, ``confusion`` a map from ``predicted|true`` kinds to counts. Scorer ``f1``
    takes a pair of unlike kinds as an error on both sides, has no ``adjusted`` and knows every kind
    of either side; ``adjacency`` keeps such pairs, recovers split and merged blocks, and knows
    the kinds that the truth has. Misses, hallucinations and misclassifications do not depend on it.
    """
    if not set(scorers) <= set(SCORERS):
        raise ValueError(f"unknown scorer among {scorers}")
    wide = "adjacency" in scorers
    wanted = ["matched", "blind", "classes", *(["splits", "merges"] if wide else [])]
    rows = page_results(pairs, *wanted, gap=GAP if wide else None)
    if wide:
        rows = recovery_counts(rows)
    n_p, n_g = F.size("pred"), F.size("gt")
    hits = F.size(F.filter("matched", same_kind))
    kind = lambda side, i: F.element_at(F.col(f"{side}.kind"), i + 1)
    wrong = F.transform(
        F.filter("blind", lambda m: ~same_kind(m)), lambda m: F.concat(
            F.coalesce(kind("pred", m["p"]), F.lit("")), F.lit("|"), F.coalesce(kind("gt", m["g"]), F.lit("")))
    )
    confusion = F.map_from_entries(F.transform(
        F.array_distinct(wrong),
        lambda k: F.struct(k.alias("key"), F.size(F.filter(wrong, lambda o: o == k)).cast("bigint").alias("value")),
    ))

    def by_kind(classes: Column) -> Column:
        return F.map_from_entries(F.transform(
            classes, lambda c: F.struct(F.coalesce(c["class"], F.lit("")).alias("key"), _prf(c["tp"], c["n_pred"] - c["tp"], c["n_gt"] - c["tp"]).alias("value"))
        ))

    plain = F.struct(
        F.lit("f1").alias("scorer"), _prf(hits, n_p - hits, n_g - hits).alias("strict"),
        F.lit(None).cast("struct<tp:bigint,fp:bigint,fn:bigint,precision:double,recall:double,f1:double>").alias("adjusted"),
        by_kind(F.col("classes")).alias("per_class"),
    )
    results = [plain] if "f1" in scorers else []
    if wide:
        strict, adjusted = (_prf(*[F.col(f"{v}_{c}") for c in ("tp", "fp", "fn")]) for v in ("strict", "adjusted"))
        results.append(F.struct(
            F.lit("adjacency").alias("scorer"), strict.alias("strict"), adjusted.alias("adjusted"),
            by_kind(F.filter("classes", lambda c: c["n_gt"] > 0)).alias("per_class"),
        ))
    return rows.select(
        "page_id", "processor",
        (n_g - F.size("blind")).cast("bigint").alias("misses"), (n_p - F.size("blind")).cast("bigint").alias("hallucinations"),
        F.size(wrong).cast("bigint").alias("misclassifications"), confusion.alias("confusion"),
        n_p.cast("bigint").alias("pred_count"), n_g.cast("bigint").alias("gt_count"),
        confidence_present(F.col("pred")).alias("confidence_present"), F.inline(F.array(*results)),
    )


def roll_up(cells: DataFrame, k: int = 5) -> DataFrame:
    """Leaderboard per processor and scorer over the cells; failed ones are only counted.

    Strict, adjusted and per-class counts are pooled before the ratios are taken; ``adjusted`` pools
    the cells that have it and is NULL without any. ``top_confusions`` has the ``k`` most frequent
    pairs of (predicted, true) kinds, ties by name. A cell sends its totals and its few named counts
    to one aggregate that is summed in the tasks first.
    """
    ok = (F.col("status") == "ok") & F.col("strict").isNotNull()
    totals = ["misses", "hallucinations", "misclassifications"]
    named = lambda part, name, *n: F.struct(
        F.lit(part).alias("part"), name.alias("name"), *[c.cast("bigint").alias(f"n{i}") for i, c in enumerate(n)]
    )
    zero = F.lit(0).cast("bigint")
    entries = F.concat(
        F.array(named("all", F.lit(""), zero, zero, zero)),
        F.transform(F.map_entries("per_class"), lambda e: named("class", e["key"], e["value"]["tp"], e["value"]["fp"], e["value"]["fn"])),
        F.transform(F.map_entries("confusion"), lambda e: named("confusion", e["key"], e["value"], zero, zero)),
    )
    group = ["processor", "scorer"]
    kept = F.when(ok, entries).otherwise(F.array(named("all", F.lit(""), zero, zero, zero)))
    rows = cells.select(
        *group, ok.alias("ok"), "strict", "adjusted", *totals, "latency_sec", "cost_usd", "confidence_present", F.inline(kept)
    )
    whole = F.col("part") == "all"
    good = whole & F.col("ok")
    sums = rows.groupBy(*group, "part", "name").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)],
        F.count_if(good).alias("n_pages"), F.count_if(whole & ~F.col("ok")).alias("n_errors"),
        *[long_sum(F.when(good, F.col(f"strict.{c}"))).alias(c) for c in ("tp", "fp", "fn")],
        *[F.sum(F.when(good, F.col(f"adjusted.{c}"))).alias(f"adjusted_{c}") for c in ("tp", "fp", "fn")],
        *[long_sum(F.when(good, F.col(c))).alias(c) for c in totals],
        F.avg(F.when(good, F.col("latency_sec"))).alias("mean_latency_sec"),
        F.sum(F.when(good, F.col("cost_usd"))).alias("total_cost_usd"),
        F.avg(F.when(good, F.col("cost_usd"))).alias("mean_cost_usd"),
        F.bool_or(good & F.col("confidence_present")).alias("confidence_present"),
    )
    carried = [c for c in sums.columns if c not in (*group, "part", "name", "n0", "n1", "n2")]
    part = F.split("name", r"\|")
    board = sums.groupBy(*group).agg(
        *[F.any_value(F.when(whole, F.col(c)), True).alias(c) for c in carried],
        F.collect_list(F.when(F.col("part") == "class", F.struct("name", _prf(F.col("n0"), F.col("n1"), F.col("n2"))))).alias("_class"),
        F.array_sort(F.collect_list(F.when(
            F.col("part") == "confusion", F.struct((-F.col("n0")).alias("less"), part[0].alias("pred"), part[1].alias("gt"))
        ))).alias("_wrong"),
    ).where("n_pages > 0")
    adjusted = [F.col(f"adjusted_{c}") for c in ("tp", "fp", "fn")]
    return with_prf(board).select(
        *group, *carried, "precision", "recall", "f1",
        *[F.when(adjusted[0].isNotNull(), c).alias(f"adjusted_{n}") for n, c in (
            ("precision", precision(adjusted[0], adjusted[1])), ("recall", recall(adjusted[0], adjusted[2])), ("f1", f1(*adjusted)))],
        F.map_from_entries("_class").alias("per_class"),
        F.transform(
            F.slice("_wrong", 1, k), lambda c: F.struct(c["pred"], c["gt"], (-c["less"]).alias("count"))
        ).alias("top_confusions"),
    )


def class_matrix(classes: DataFrame, processors: list[str], value: str = "f1") -> DataFrame:
    """Class by processor; a missing combination stays NULL."""
    return classes.groupBy("class").pivot("processor", processors).agg(F.first(value))


def pareto_inputs(board: DataFrame, cost: str) -> DataFrame:
    """(label, x, y) points for the frontier; processors without the cost are left out."""
    return board.where(F.col(cost).isNotNull()).select(
        F.col("processor").alias("label"), F.col(cost).alias("x"), F.col("f1").alias("y")
    )


def page_dims(pred_pages: DataFrame, gt_pages: DataFrame) -> DataFrame:
    """Largest known width and height of a page over both sides, at least 1."""
    both = pred_pages.select("page_id", "width", "height").unionByName(
        gt_pages.select("page_id", "width", "height")
    )
    side = lambda c: F.greatest(
        F.coalesce(F.max(c), F.lit(1)), F.lit(1)
    ).alias(c)
    return both.groupBy("page_id").agg(side("width"), side("height"))


def processors_without_predictions(
    wanted: DataFrame, predictions: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """Wanted processors (within ``by``) for which no prediction is stored."""
    keys = [*(by or []), "processor"]
    return wanted.select(*keys).join(predictions.select(*keys).distinct(), keys, "left_anti")
