"""Cost, latency and spend. An unknown cost is NULL and never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.prefix import join_same, medians, prefix_sums
from gradeline.functions.ratio import count_if, share

# Token guess per cell of a dry run.
GUESS_INPUT, GUESS_OUTPUT = 2000, 120


def parse_cost(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Page-rated cost per row; NULL without a page rate or a page count."""
    rates = catalog.where("unit = 'page'").select("provider", "usd")
    return rows.join(rates, "provider", "left").withColumn(
        "cost", F.col("usd") * F.col("pages")
    ).drop("usd")


def agent_cost(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Token-rated cost per row, rates per thousand tokens."""
    rates = catalog.where("unit = 'tokens'").select(
        "provider", "input_usd_per_1k", "output_usd_per_1k"
    )
    cost = (
        F.col("input_usd_per_1k") * F.col("input_tokens") / 1000
        + F.col("output_usd_per_1k") * F.col("output_tokens") / 1000
    )
    return rows.join(rates, "provider", "left").withColumn("cost", cost).drop(
        "input_usd_per_1k", "output_usd_per_1k"
    )


def usage_count(usage: Column, path: str) -> Column:
    """A token count from a usage VARIANT; absent and null both count as zero."""
    return F.coalesce(F.try_variant_get(usage, path, "bigint"), F.lit(0).cast("bigint"))


def billable_output_tokens(usage: Column) -> Column:
    """Visible completion plus hidden thinking tokens."""
    return usage_count(usage, "$.completion_tokens") + usage_count(
        usage, "$.gemini_usage.thoughtsTokenCount"
    )


def unaccounted_tokens(usage: Column) -> Column:
    """Provider total minus counted tokens; 0 where no provider total exists."""
    total = F.coalesce(
        F.nullif(usage_count(usage, "$.gemini_usage.totalTokenCount"), F.lit(0)),
        F.nullif(usage_count(usage, "$.bedrock_usage.totalTokens"), F.lit(0)),
    )
    counted = usage_count(usage, "$.prompt_tokens") + billable_output_tokens(usage)
    return F.coalesce(total - counted, F.lit(0).cast("bigint"))


def row_cost(usage: Column, input_rate: Column, output_rate: Column) -> Column:
    """Provider-stated cost, else registry rates per million tokens, else NULL."""
    stated = F.try_variant_get(usage, "$.cost", "double")
    rated = (
        usage_count(usage, "$.prompt_tokens") / 1e6 * input_rate
        + billable_output_tokens(usage) / 1e6 * output_rate
    )
    return F.coalesce(stated, rated)


def direct_cost_latency(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Median latency and realised cost per direct leg.

    ``entries`` maps ``parser`` to its registry columns. A local leg has latency and no cost; a leg
    without one priced row has none either.
    """
    joined = rows.join(
        entries.select("parser", "local", "input_per_mtok", "output_per_mtok"), "parser", "left"
    )
    cost = row_cost(F.col("usage"), F.col("input_per_mtok"), F.col("output_per_mtok"))
    sums = joined.groupBy("parser").agg(
        F.count("*").alias("n"),
        F.sum(F.when(~F.coalesce("local", F.lit(False)), cost)).alias("cost_usd"),
    )
    return join_same(sums, medians(rows, ["parser"], "latency_sec", "median_latency"), ["parser"], "left")


def transcriber_cost_latency(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Median latency and cost per transcriber over fine parses, with the cost's standing.

    An all-zero total is ``unpriced`` without registry rates and ``unrecorded`` with them.
    """
    priced = F.col("input_per_mtok").isNotNull()
    ok = meta.where("ok").join(
        entries.select("parser", "local", priced.alias("priced")), "parser", "left"
    )
    sums = ok.groupBy("parser").agg(
        F.sum("cost_usd").alias("total"),
        F.coalesce(F.bool_or("priced"), F.lit(False)).alias("priced"),
        F.coalesce(F.bool_or("local"), F.lit(False)).alias("local"),
    )
    status = (
        F.when(F.col("local"), "local")
        .when(F.col("total").isNull(), "none")
        .when((F.col("total") == 0) & ~F.col("priced"), "unpriced")
        .when(F.col("total") == 0, "unrecorded")
        .otherwise("recorded")
    )
    middle = medians(meta.where("ok"), ["parser"], "latency_sec", "median_latency")
    return join_same(sums, middle, ["parser"], "left").select(
        "parser", "median_latency", status.alias("cost_status"),
        F.when(status == "recorded", F.col("total")).alias("cost_usd"),
    )


def transcriber_row_cost(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry-rated cost of a transcription; NULL without rates or without usage."""
    used = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) > 0
    cost = (
        F.coalesce("input_tokens", F.lit(0)) / 1e6 * F.col("input_per_mtok")
        + F.coalesce("output_tokens", F.lit(0)) / 1e6 * F.col("output_per_mtok")
    )
    rates = entries.select("parser", "input_per_mtok", "output_per_mtok")
    return rows.join(rates, "parser", "left").withColumn("cost", F.when(used, cost)).drop(
        "input_per_mtok", "output_per_mtok"
    )


def spend_ledger(rows: DataFrame, by: list[str], cap: float) -> DataFrame:
    """First row whose running cost passes ``cap``; an unknown cost stops the run where it stands.

    ``rows`` has ``ts``, ``row_id`` and ``cost``. ``reason`` is ``cap``, ``unknown cost`` or
    ``within cap``.
    """
    ledger = prefix_sums(rows, by, ["ts", "row_id"], {"running": "cost"})
    unknown = F.col("cost").isNull()
    stop = unknown | (F.col("running") > cap)
    at = F.struct("ts", "row_id")
    first = ledger.groupBy(*by).agg(
        F.min_by(F.struct("row_id", "running", unknown.alias("unknown")), F.when(stop, at))
        .alias("stop"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total"),
        count_if(unknown).alias("n_unknown"),
    )
    return first.select(
        *by, "total", "n_unknown",
        F.col("stop.row_id").alias("stop_row"),
        F.col("stop.running").alias("stop_spend"),
        F.when(F.col("stop").isNull(), "within cap")
        .when(F.col("stop.unknown"), "unknown cost").otherwise("cap").alias("reason"),
    )


def dry_run_estimate(pending: DataFrame, entries: DataFrame) -> DataFrame:
    """Cells to run per leg, with an estimate from a fixed token guess; NULL where unpriced."""
    cells = pending.groupBy("parser").agg(F.count("*").alias("cells"))
    rates = entries.select("parser", "input_per_mtok", "output_per_mtok")
    each = (
        F.lit(GUESS_INPUT / 1e6) * F.col("input_per_mtok")
        + F.lit(GUESS_OUTPUT / 1e6) * F.col("output_per_mtok")
    )
    return cells.join(rates, "parser", "left").select(
        "parser", "cells", F.round(F.col("cells") * each, 2).alias("est_usd"),
        each.isNotNull().alias("priced"),
    )


def decision_table(
    accuracy: DataFrame, costs: DataFrame, majority_right: Column, pages: Column
) -> DataFrame:
    """Errors per thousand, cost per 10,000 pages, errors avoided and the price of one.

    ``accuracy`` holds parser, n and correct; ``costs`` holds parser and cost_usd.
    """
    rows = accuracy.join(costs.select("parser", "cost_usd"), "parser", "left")
    avoided = F.col("correct") - majority_right
    return rows.select(
        "parser", "correct",
        share(F.col("correct"), F.col("n")).alias("accuracy"),
        (share(F.col("n") - F.col("correct"), F.col("n")) * 1000).alias("errors_per_1000"),
        (F.col("cost_usd") / pages * 10000).alias("cost_per_10k_pages"),
        avoided.alias("errors_avoided"),
        F.when(avoided > 0, F.col("cost_usd") / avoided).alias("cost_per_error_avoided"),
    )


def deduplicated_input(rows: DataFrame) -> DataFrame:
    """Image tokens per leg when each page is charged once instead of once per question."""
    per_doc = rows.groupBy("parser", "doc").agg(
        F.sum("image_tokens").alias("all"), F.max("image_tokens").alias("once")
    )
    return per_doc.groupBy("parser").agg(
        F.sum("all").alias("tokens_per_question"), F.sum("once").alias("tokens_per_page"),
        (1 - share(F.sum("once"), F.sum("all"))).alias("saved_share"),
    )


def spend_rollup(rows: DataFrame) -> DataFrame:
    """Cost by session and leg with subtotals and the grand total; unknown costs counted apart."""
    return rows.rollup("session", "parser").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("cost").alias("cost"),
        count_if(F.col("cost").isNull()).alias("n_unknown"),
        F.count("*").alias("n"),
    )
