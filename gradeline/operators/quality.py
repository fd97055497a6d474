"""Data-quality gates. Each returns the violations; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.ratio import count_if
from gradeline.operators.metrics import BLANK_TAGS, CHECKBOX_TAGS, has_any_tag


def bank_counts(bank: DataFrame) -> DataFrame:
    """The twelve cardinalities of a bank as (name, measured) rows, from one pass."""
    box = has_any_tag(F.col("capabilities"), CHECKBOX_TAGS)
    blank = has_any_tag(F.col("capabilities"), BLANK_TAGS)
    kinds = F.transform("fields", lambda f: f["gold_kind"])
    truths = F.transform("fields", lambda f: f["gold_true"])
    n_of = lambda arr, test: F.size(F.filter(arr, test))
    per_q = bank.select(
        "doc",
        box.alias("box"),
        blank.alias("blank"),
        F.size("fields").alias("fields"),
        n_of(kinds, lambda k: k == "null").alias("nulls"),
        n_of(kinds, lambda k: k == "bool").alias("bools"),
        n_of(truths, lambda t: F.coalesce(t, F.lit(False))).alias("trues"),
    )
    b, k = F.col("box"), F.col("blank")
    total = lambda c, use=None: F.coalesce(
        F.sum(c if use is None else F.when(use, c)), F.lit(0)
    ).cast("bigint")
    one = per_q.agg(
        F.count("*").alias("bank_items"),
        total(F.col("fields")).alias("bank_fields"),
        total(F.col("nulls")).alias("bank_nulls"),
        count_if(b).alias("checkbox_questions"),
        F.count_distinct(F.when(b, F.col("doc"))).alias("checkbox_docs"),
        total(F.col("fields"), b).alias("checkbox_fields"),
        total(F.col("bools"), b).alias("checkbox_booleans"),
        total(F.col("trues"), b).alias("checkbox_true"),
        total(F.col("bools") - F.col("trues"), b).alias("checkbox_false"),
        count_if(k).alias("blank_questions"),
        total(F.col("nulls"), k).alias("blank_nulls"),
        count_if(b & k).alias("bucket_overlap"),
    )
    return one.unpivot([], one.columns, "name", "measured")


def bank_mismatches(bank: DataFrame, pins: DataFrame) -> DataFrame:
    """Counts that differ from the pinned (name, expected) rows."""
    return bank_counts(bank).join(pins, "name").where("measured <> expected")


def missing_documents(bank: DataFrame, corpus: DataFrame) -> DataFrame:
    """Bank documents that the corpus lacks."""
    return bank.select("doc").distinct().join(corpus.select("doc"), "doc", "left_anti")


def serving_identity(rows: DataFrame) -> DataFrame:
    """System keys whose answered rows name more than one provider; an empty name is its own."""
    name = F.coalesce(F.nullif("resolved_provider", F.lit("")), F.lit("(empty)"))
    return (
        rows.where("error_class = 'none'").groupBy("parser")
        .agg(
            F.count_distinct(name).alias("n_providers"),
            F.array_join(F.array_sort(F.collect_set(name)), ",").alias("providers"),
        )
        .where("n_providers > 1")
    )


def stale_windows(rows: DataFrame, days: int = 7) -> DataFrame:
    """System keys collected over more than ``days`` days.

    A key needs two stamps; one stamp that cannot be read leaves it without a verdict.
    """
    ts = F.try_to_timestamp("retrieved_at")
    return (
        rows.where(F.coalesce("retrieved_at", F.lit("")) != "").groupBy("parser")
        .agg(
            F.count("*").alias("n"),
            count_if(ts.isNull()).alias("unread"),
            F.min(ts).alias("first"),
            F.max(ts).alias("last"),
        )
        .where((F.col("n") >= 2) & (F.col("unread") == 0))
        .where(F.col("last") - F.col("first") > F.expr(f"INTERVAL '{days}' DAY"))
        .select("parser", "n", "first", "last")
    )


def incomplete_items(bank: DataFrame) -> DataFrame:
    """Bank items without a document or without gold fields."""
    no_doc = F.coalesce("doc", F.lit("")) == ""
    no_gold = F.col("fields").isNull() | (F.size("fields") == 0)
    return bank.where(no_doc | no_gold).select(
        "qid", no_doc.alias("no_document"), no_gold.alias("no_gold")
    )


def duplicate_ids(*tables: DataFrame) -> DataFrame:
    """Ids that occur more than once within or across tables."""
    ids = tables[0].select("id")
    for t in tables[1:]:
        ids = ids.unionByName(t.select("id"))
    return ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def near_empty_transcripts(meta: DataFrame, per_page: int = 16) -> DataFrame:
    """Fine parses whose text is no longer than ``per_page`` characters per page."""
    floor = F.lit(per_page) * F.greatest(F.lit(1), F.coalesce("page_count", F.lit(0)))
    return meta.where(F.col("ok") & (F.col("md_length") <= floor))


def content_drift(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Stored hashes that no longer equal the current bytes of a document.

    ``files`` holds doc and content (binary). Empty or missing bytes cannot confirm a row.
    """
    current = files.where(F.length("content") > 0).select(
        "doc", F.sha2("content", 256).alias("current_sha")
    )
    asked = rows.where(F.coalesce("image_sha", F.lit("")) != "").select(
        "parser", "doc", "image_sha"
    ).distinct()
    state = F.when(F.col("current_sha").isNull(), "UNAVAILABLE").when(
        F.col("current_sha") != F.col("image_sha"), "STALE"
    )
    return asked.join(current, "doc", "left").select(
        "parser", "doc", state.alias("state")
    ).where(F.col("state").isNotNull())


def bank_subset(bank: DataFrame, tags: list[str]) -> DataFrame:
    return bank.where(has_any_tag(F.col("capabilities"), tags))


def encoded_length(raw_bytes: Column) -> Column:
    """Length of the base64 form."""
    return F.ceil(raw_bytes / F.lit(3)) * 4


def oversized_payloads(rows: DataFrame, bank: DataFrame, limit: int) -> DataFrame:
    """Cells above the encoded limit per leg, and how many hold a boolean checkbox field."""
    big = rows.where(encoded_length(F.col("image_bytes")) > limit)
    box = has_any_tag(F.col("capabilities"), CHECKBOX_TAGS)
    metric = box & F.exists("fields", lambda f: f["gold_kind"] == "bool")
    return big.join(bank.select("qid", metric.alias("metric")), "qid").groupBy("parser").agg(
        F.count("*").alias("n_cells"), count_if(F.col("metric")).alias("n_metric_cells"),
        F.count_distinct("doc").alias("n_docs"),
    )
