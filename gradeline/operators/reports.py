"""Leaderboards and the stamps, labels and frontiers around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions.ratio import count_if, share
from gradeline.functions.text import safe_entry_name
from gradeline.operators import metrics, stats
from gradeline.operators.cells import cells, expand_outcomes, section_of
from gradeline.session import written

# First public day of the data set, and the family of the answer extractor.
CONTAMINATION_CUTOFF = "2026-05-24"
EXTRACTOR_FAMILY = "google"
UNKNOWN = "unknown (unregistered)"


def resolve_entries(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry columns per system key; unresolved keys stay with NULLs.

    A ``vlm__`` key names its entry between the prefix and the last ``__``. Other keys match the
    safe name of a compatible transcriber in front of a ``__``, else an upstream parser exactly.
    All three rules are equality joins: a key offers each of its prefixes. The first registry
    entry in file order wins (column ``ord``).
    """
    key = F.col("parser")
    keys = keys.select("parser").distinct()
    direct = keys.where(key.startswith("vlm__")).select(
        "parser", F.regexp_extract(key, "^vlm__(.*)__[^_]*(?:_[^_]+)*$", 1).alias("probe")
    )
    direct = direct.join(
        registry.where("shape = 'vlm-chat'"), F.col("probe") == F.col("id")
    ).withColumn("rule", F.lit(0))
    other = keys.where(~key.startswith("vlm__"))
    parts = F.split(key, "__")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "__"),
    )
    compatible = registry.where("shape = 'transcriber' AND transport = 'openai-compat'")
    by_prefix = (
        other.where(F.size(parts) > 1).select("parser", F.explode(prefixes).alias("probe"))
        .join(compatible, F.col("probe") == safe_entry_name(F.col("id")))
        .withColumn("rule", F.lit(1))
    )
    upstream = registry.where("transport = 'upstream-parser'")
    by_name = other.withColumn("probe", key).join(
        upstream, F.col("probe") == F.col("upstream_parser")
    ).withColumn("rule", F.lit(2))
    found = direct.unionByName(by_prefix).unionByName(by_name).drop("probe")
    first = Window.partitionBy("parser").orderBy("rule", "ord")
    best = found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "rule")
    return keys.join(best, "parser", "left")


def labels(entries: DataFrame, by: list[str] = ()) -> DataFrame:
    """Row labels; an entry behind several keys gets its condition hash appended."""
    n = F.count("id").over(Window.partitionBy(*by, "id"))
    tail = F.element_at(F.split("parser", "__"), -1)
    label = (
        F.when(F.col("id").isNull(), F.concat("parser", F.lit(" (unregistered)")))
        .when(n > 1, F.concat("id", F.lit(" [cond "), tail, F.lit("]")))
        .otherwise(F.col("id"))
    )
    return entries.withColumn("label", label)


def precision_label(precision: Column) -> Column:
    return F.when(precision == "provider-default", "unknown (not asserted)").otherwise(precision)


def stamps(entries: DataFrame) -> DataFrame:
    """Precision, licence, terms, contamination and contract per key."""
    known = F.col("id").isNotNull()
    note = F.when(
        F.coalesce("tos_note", F.lit("")) != "",
        F.concat(F.lit(" — "), F.substring("tos_note", 1, 60)),
    ).otherwise("")
    say = lambda c: F.when(known, c).otherwise(UNKNOWN)
    return entries.select(
        "parser",
        say(precision_label(F.col("precision"))).alias("precision"),
        say(F.col("weights_licence")).alias("licence"),
        say(F.concat("provider_tos_commercial", note)).alias("tos"),
        say(F.when(F.col("release_date") > CONTAMINATION_CUTOFF, "yes").otherwise("no"))
        .alias("contaminated"),
        say(F.when(F.col("promptable"), "promptable").otherwise("not-promptable"))
        .alias("contract"),
    )


def mixed_precision(entries: DataFrame, by: list[str]) -> DataFrame:
    """Per section: ``mixed``, ``unasserted`` or no note (NULL), over registered rows."""
    seen = F.array_sort(F.collect_set(precision_label(F.col("precision"))))
    return entries.where(F.col("id").isNotNull()).groupBy(*by).agg(seen.alias("_p")).select(
        *by, F.array_join("_p", ", ").alias("precisions"),
        F.when(F.size("_p") > 1, "mixed precision")
        .when(F.col("_p")[0] == "unknown (not asserted)", "precision unasserted").alias("note"),
    )


def input_label(entries: DataFrame) -> DataFrame:
    """What the provider received: the stated mode, else by transport."""
    proxy = F.when(F.col("transport") == "openai-compat", "raster-png").otherwise("pdf-direct")
    return entries.select(
        "parser",
        F.when(F.col("id").isNull(), UNKNOWN).otherwise(F.coalesce("input_mode", proxy))
        .alias("input"),
    )


def calibration_pairs(entries: DataFrame) -> DataFrame:
    """Direct and transcriber keys of the same model."""
    model = F.coalesce("model", F.lit("")) != ""
    v = entries.where(model & F.col("parser").startswith("vlm__")).select(
        F.col("parser").alias("direct"), "model"
    )
    t = entries.where(
        model & ~F.col("parser").startswith("vlm__") & (F.col("transport") == "openai-compat")
    ).select(F.col("parser").alias("transcriber"), "model")
    return v.join(t, "model").select("direct", "transcriber", "model").distinct()


def row_metrics(
    bank: DataFrame, scored: DataFrame, systems, *, iters: int = stats.ITERATIONS, seed: int = 0,
    alpha: float = stats.ALPHA,
) -> DataFrame:
    """The wide row per system: checkbox, blank and general accuracy, coverage, intervals, verdict.

    Bank and rows are joined once, and the outcomes written beside what their cells hold; one
    aggregate takes the point values and the checkbox confusion (tt, tf, ft, ff, err) from them, one
    the cells' values from each cell's first row, one resampling both intervals, and one the verdict.
    ``error_classes`` maps the classes of a system's cells to their counts.
    """
    s, kind = F.col("status"), F.col("gold_kind")
    stored = scored.select(
        "qid", "parser", "error", "error_class", "has_answer", "is_object", "field_matches", "null_keys",
        "match", F.lit(True).alias("has_row"),
    )
    gold = bank.select("qid", "doc", metrics.has_any_tag(F.col("capabilities"), metrics.CHECKBOX_TAGS).alias("tagged"), "fields")
    joined = cells(gold, stored, systems).withColumn("class", metrics.error_class(F.coalesce("has_row", F.lit(False))))
    kept = written(
        expand_outcomes(joined, "tagged", "match", "has_row", "class", outer=True).select(
            "parser", "qid", "key", "doc", "gold_kind", "gold_true", "status",
            F.when(F.col("tagged") & (kind == "bool"), "checkbox").when(kind == "null", "null").alias("flag"),
            "at", "match", "has_row", "class",
        ),
        "row-metrics",
    )
    out = kept.where(F.col("at").isNotNull())
    once = kept.where(F.coalesce("at", F.lit(0)) == 0)
    box, null = (F.coalesce(F.col("flag") == f, F.lit(False)) for f in ("checkbox", "null"))
    right, off = s == "correct", s == "incorrect"
    t = F.coalesce("gold_true", F.lit(False))
    wide = out.groupBy("parser").agg(
        share(count_if(box & right), count_if(box)).alias("checkbox_acc"),
        share(count_if(box & t & right), count_if(box & t)).alias("checked_acc"),
        share(count_if(box & ~t & right), count_if(box & ~t)).alias("unchecked_acc"),
        count_if(box & t & right).alias("tt"), count_if(box & t & off).alias("tf"),
        count_if(box & ~t & off).alias("ft"), count_if(box & ~t & right).alias("ff"),
        count_if(box & (s == "error")).alias("err"),
        F.count_distinct(F.when(box, F.col("doc"))).alias("checkbox_docs"),
        share(count_if(null & right), count_if(null)).alias("null_acc"),
        share(count_if(null & off), count_if(null & (s != "error"))).alias("hallucination_rate"),
        F.count_distinct(F.when(null, F.col("doc"))).alias("null_docs"),
        share(count_if(right), F.count("*")).alias("general_field_acc"),
    )
    both = stats.cluster_bootstrap_ci(
        out.where(F.col("flag").isNotNull()), ["flag"], iters=iters, seed=seed, alpha=alpha
    )
    bounds = both.groupBy("parser").agg(*[
        F.max(F.when(F.col("flag") == f, F.col(c))).alias(f"{f}_{c}") for f in ("checkbox", "null") for c in ("lo", "hi")
    ])
    # Each system has all gold fields, so those of one are the bank's.
    golds = out.where(box & (F.col("parser") == kept.agg(F.min("parser")).scalar()))
    beats = stats.beats_majority(
        out.where(box), metrics.majority_leg(golds), iters=iters, seed=seed, alpha=alpha,
    ).select("parser", F.col("verdict").alias("beats_majority"))
    classes = once.groupBy("parser", "class").agg(F.count("*").alias("n")).groupBy("parser").agg(
        F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("error_classes")
    )
    return (
        wide.join(once.groupBy("parser").agg(metrics.strict_share(), *metrics.coverage()), "parser")
        .join(classes, "parser", "left")
        .join(bounds, "parser", "left")
        .join(beats, "parser", "left")
    )


def leaderboard(rows: DataFrame, entries: DataFrame, section: str) -> DataFrame:
    """One section's table: registered rows first, then by label. Sections never mix."""
    named = labels(entries).select("parser", "label", "id", "provenance")
    part = rows.where(section_of(F.col("parser"), F.col("no_image")) == section)
    family = F.lower(F.trim(F.coalesce("provenance", F.lit("")))) == EXTRACTOR_FAMILY
    return (
        part.join(named, "parser", "left")
        .withColumns({"same_family": family, "registered": F.col("id").isNotNull()})
        .orderBy(F.desc("registered"), "label")
    )


def sorted_table(df: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Generic report order: NULLs lead a descending table and end an ascending one."""
    return df.orderBy(F.desc_nulls_first(by) if descending else F.asc_nulls_last(by))


def _skyline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct points of a partition that none of its points beats."""
    x = y = np.zeros(0)
    for batch in batches:
        x, y = (np.concatenate([kept, batch.column(c).to_numpy()]) for kept, c in ((x, "x"), (y, "y")))
        order = np.lexsort((-y, x))
        x, y = x[order], y[order]
        best = np.maximum.accumulate(y)
        keep = np.ones(len(y), dtype=bool)
        keep[1:] = y[1:] > best[:-1]
        x, y = x[keep], y[keep]
    if len(x):
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])


def frontier(points: DataFrame, slices: int | None = None) -> DataFrame:
    """Distinct (x, y) that no other point beats: lower x or equal, higher y or equal, one strictly.

    Each task keeps only its own frontier. What is left is dealt out by quantiles of x, cut to the
    frontier of each range, and must rise above the best y of the ranges before. ``slices`` is the
    number of ranges, by default that of the session's shuffles. NULL and NaN are never on it.
    """
    known = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = known.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    # Written, as dealing by quantiles looks at its input twice.
    local = written(known.mapInArrow(_skyline, "x double, y double"), "frontier-tasks")
    dealt = local.repartitionByRange("x") if slices is None else local.repartitionByRange(slices, "x")
    ranged = dealt.mapInArrow(_skyline, "x double, y double")
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "frontier")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("_part").agg(F.max("y").alias("_top")).select("_part", F.max("_top").over(before).alias("_before"))
    lead = ranged.join(tops, "_part").where(F.col("_before").isNull() | (F.col("y") > F.col("_before")))
    return written(lead.select("x", "y"), "frontier")


def pareto(points: DataFrame, slices: int | None = None) -> DataFrame:
    """Mark the points whose (x, y) lies on the :func:`frontier`; only that is joined to them."""
    lead = frontier(points, slices).select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    on = (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y"))
    return points.join(lead, on, "left").withColumn("on_frontier", F.col("_x").isNotNull()).drop("_x", "_y")


def reproduction_gate(scored: DataFrame) -> DataFrame:
    """Stored-verdict accuracy of the transcribers, for comparison with published figures only."""
    rows = scored.where(~F.col("parser").startswith("vlm__"))
    return metrics.stored_construction(rows).orderBy("parser")


def against_targets(gate: DataFrame, targets: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Difference to published field and question percentages; within means both are."""
    rows = gate.join(targets, "parser")
    f = F.col("field_share") * 100 - F.col("target_field_pct")
    q = F.col("question_share") * 100 - F.col("target_question_pct")
    return rows.select(
        "parser", f.alias("field_diff"), q.alias("question_diff"),
        ((F.abs(f) <= tolerance) & (F.abs(q) <= tolerance)).alias("within"),
    )
