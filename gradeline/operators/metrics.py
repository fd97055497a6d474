"""Accuracy, error and coverage metrics over field outcomes and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions.prefix import MIDDLE, dense_numbers, join_same, rank_values
from gradeline.functions.ratio import count_if, percent, share
from gradeline.operators.cells import across_systems

# Tags of the two special buckets.
CHECKBOX_TAGS = ["checkbox_state", "handdrawn_check", "form_checkbox_grid"]
BLANK_TAGS = ["blank_field"]


def has_any_tag(capabilities: Column, tags: list[str]) -> Column:
    return F.coalesce(
        F.arrays_overlap(capabilities, F.array(*[F.lit(t) for t in tags])), F.lit(False)
    )


def block_columns(status: Column, only: Column | None = None) -> list[Column]:
    """The metric block as aggregates; errors count as wrong in ``acc_over_all``."""
    use = F.lit(True) if only is None else only
    n = count_if(use)
    correct = count_if(use & (status == "correct"))
    answered = count_if(use & (status != "error"))
    return [
        n.alias("n"),
        answered.alias("n_answered"),
        share(correct, n).alias("acc_over_all"),
        share(correct, answered).alias("acc_over_answered"),
        share(n - answered, n).alias("error_rate"),
    ]


def metric_block(outcomes: DataFrame, by: list[str]) -> DataFrame:
    return outcomes.groupBy(*by).agg(*block_columns(F.col("status")))


def boolean_gold(outcomes: DataFrame) -> DataFrame:
    """Checkbox-bucket fields with a boolean gold value."""
    return outcomes.where(
        has_any_tag(F.col("capabilities"), CHECKBOX_TAGS) & (F.col("gold_kind") == "bool")
    )


def null_gold(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("gold_kind") == "null")


def checkbox_metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Overall block, accuracy by gold polarity and the confusion counts.

    A gold value that is not boolean stops the job.
    """
    gold = F.when(F.col("gold_kind") == "bool", F.col("gold_true")).otherwise(
        F.raise_error(F.lit("checkbox metrics need boolean gold values")).cast("boolean")
    )
    rows = outcomes.withColumn("_t", gold)
    t, s = F.col("_t"), F.col("status")
    right, off = s == "correct", s == "incorrect"
    return rows.groupBy(*by).agg(
        *block_columns(s),
        share(count_if(t & right), count_if(t)).alias("acc_checked"),
        share(count_if(~t & right), count_if(~t)).alias("acc_unchecked"),
        count_if(t & right).alias("tt"),
        count_if(t & off).alias("tf"),
        count_if(~t & off).alias("ft"),
        count_if(~t & right).alias("ff"),
        count_if(s == "error").alias("err"),
    )


def null_metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Blank-field block with the rate of invented values among answered fields."""
    s = F.col("status")
    return outcomes.groupBy(*by).agg(
        *block_columns(s),
        share(count_if(s == "incorrect"), count_if(s != "error")).alias("hallucination_rate"),
    )


def true_values(matches: Column) -> Column:
    """Number of true verdicts in a ``field_matches`` map."""
    return F.size(F.filter(F.map_values(matches), lambda v: v))


def score_sums() -> list[Column]:
    """Field and question counts of scored rows as aggregates."""
    n_true = F.coalesce(true_values(F.col("field_matches")), F.lit(0))
    n_all = F.when(F.col("field_matches").isNull(), 0).otherwise(F.size("field_matches"))
    return [
        F.coalesce(F.sum(n_true), F.lit(0)).cast("bigint").alias("field_ok"),
        F.coalesce(F.sum(n_all), F.lit(0)).cast("bigint").alias("field_tot"),
        count_if(F.coalesce("match", F.lit(False))).alias("q_ok"),
        F.count("*").cast("bigint").alias("q_tot"),
    ]


def with_percents(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "field_pct": percent(F.col("field_ok"), F.col("field_tot")),
            "q_pct": percent(F.col("q_ok"), F.col("q_tot")),
        }
    )


def system_summary(scored: DataFrame) -> DataFrame:
    """Field and question accuracy per system over rows that hold an answer."""
    return with_percents(scored.where("has_answer").groupBy("parser").agg(*score_sums()))


def dashboard_rows(scored: DataFrame) -> DataFrame:
    """Rows a dashboard shows: an answer and no error."""
    return scored.where(F.col("has_answer") & F.col("error").isNull())


def dashboard_summary(scored: DataFrame, merge_domains: dict[str, str] | None = None) -> DataFrame:
    """Overall and per-domain accuracy in one pass; ``domain`` is NULL on the overall rows."""
    rows = dashboard_rows(scored)
    if merge_domains:
        rows = rows.replace(merge_domains, subset=["domain"])
    sums = rows.groupingSets([["parser"], ["parser", "domain"]], "parser", "domain").agg(
        F.grouping("domain").cast("int").alias("overall"), *score_sums()
    )
    out = with_percents(sums)
    return out.withColumns(
        {"field_pct": F.round("field_pct", 1), "q_pct": F.round("q_pct", 1)}
    )


def domain_matrix(scored: DataFrame, domains: list[str]) -> DataFrame:
    """Field accuracy, one column per domain, 0 where a system has nothing there."""
    rows = dashboard_rows(scored)
    sums = rows.groupBy("parser").pivot("domain", domains).agg(*score_sums()[:2])
    return sums.select(
        "parser",
        *[
            F.round(
                percent(
                    F.coalesce(F.col(f"`{d}_field_ok`"), F.lit(0)),
                    F.coalesce(F.col(f"`{d}_field_tot`"), F.lit(0)),
                ),
                1,
            ).alias(d)
            for d in domains
        ],
    )


def bucket_map(bank: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, qid) pairs; a question enters a bucket once however many tags agree.

    The tag rows meet by equality, and only distinct pairs leave, so no tag expands into pairs of
    questions.
    """
    tag_rows = buckets.select("ord", "name", F.explode("tags").alias("tag")).distinct()
    asked = bank.select("qid", F.explode(F.array_distinct("capabilities")).alias("tag"))
    return asked.join(tag_rows, "tag").select("ord", "name", "qid").distinct()


def bucket_scores(bank: DataFrame, scored: DataFrame, buckets: DataFrame) -> DataFrame:
    """Field and question accuracy per (bucket, system)."""
    rows = dashboard_rows(scored).join(bucket_map(bank, buckets), "qid")
    sums = with_percents(rows.groupBy("ord", "name", "parser").agg(*score_sums()))
    return sums.withColumns({"field_pct": F.round("field_pct", 1), "q_pct": F.round("q_pct", 1)})


def bucket_sizes(bank: DataFrame, buckets: DataFrame) -> DataFrame:
    """Questions per bucket; a bucket whose tags nobody uses stays, with zero."""
    sizes = bucket_map(bank, buckets).groupBy("ord").agg(F.count("*").alias("n_qs"))
    return buckets.join(sizes, "ord", "left").select(
        "ord", "name", F.coalesce("n_qs", F.lit(0)).cast("bigint").alias("n_qs")
    )


def question_votes(scored: DataFrame) -> DataFrame:
    """Per question: systems that answered and systems that were fully right."""
    right = F.coalesce("match", F.lit(False))
    return dashboard_rows(scored).groupBy("qid").agg(
        F.count("*").cast("bigint").alias("n_with"), count_if(right).alias("n_right")
    )


def discriminative_examples(
    bank: DataFrame, scored: DataFrame, buckets: DataFrame, *, top: int = 6, min_systems: int = 5
) -> DataFrame:
    """The questions of each bucket on which systems disagree most (wrong x right).

    ``row_number() <= top`` lets Spark keep only the leading rows of each bucket in every task
    before the shuffle, so a huge bucket does not gather in one place.
    """
    votes = question_votes(scored).where(F.col("n_with") >= min_systems)
    votes = votes.withColumn("score", (F.col("n_with") - F.col("n_right")) * F.col("n_right"))
    order = Window.partitionBy("ord").orderBy(F.desc("score"), "qid")
    return (
        bucket_map(bank, buckets)
        .join(votes, "qid")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )


def question_browser(bank: DataFrame, scored: DataFrame, answers: DataFrame) -> DataFrame:
    """Per question and gold key what every shown system answered and whether it is right.

    ``answers`` (qid, parser, answer) holds the answers as VARIANT. ``given`` maps a system to its
    value and verdict; a system without the key has a NULL value, one without a shown row no entry.
    ``place`` numbers the questions 0, 1, 2, … hardest first: by the number of systems that have
    the whole question right, then by qid. Stored rows and answers are gathered by question once and
    meet there; keys are expanded last, so no row per key is shuffled.
    """
    shown = dashboard_rows(scored).groupBy("qid").agg(F.collect_list(F.struct("parser", "field_matches")).alias("_rows"))
    # Answers travel as they are: as a map, every value would have its own copy of the answer's names.
    answered = answers.where("parser IS NOT NULL").groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("parser", "answer"))).alias("_answers")
    )
    fields = bank.select("qid", "doc", "domain", F.transform("fields", lambda f: f["key"]).alias("_keys"))
    votes = question_votes(scored).select(
        "qid", F.col("n_with").alias("n_parsers"), F.col("n_right").alias("n_correct")
    )
    placed = dense_numbers(bank.select("qid").join(votes, "qid"), ["n_correct", "qid"], "place")
    asked = shown.join(fields, "qid").join(placed, "qid").join(answered, "qid", "left")

    def with_values(row: Column) -> Column:
        values = F.try_variant_get(F.try_element_at("_answers", row["parser"]), "$", "map<string,variant>")
        return F.struct(row["parser"].alias("parser"), row["field_matches"].alias("marks"), values.alias("values"))

    about = ["doc", "domain", "n_parsers", "n_correct", "place"]
    per_key = asked.withColumn("_rows", F.transform("_rows", with_values)).select("qid", *about, "_rows", F.explode("_keys").alias("key"))

    def entry(row: Column) -> Column:
        given = F.struct(
            F.try_element_at(row["values"], F.col("key")).alias("value"),
            F.coalesce(F.try_element_at(row["marks"], F.col("key")), F.lit(False)).alias("right"),
        )
        return F.struct(row["parser"].alias("parser"), given.alias("given"))

    per_key = per_key.withColumn("_given", F.transform("_rows", entry)).drop("_rows")
    right = F.transform(F.filter("_given", lambda e: e["given"]["right"]), lambda e: e["parser"])
    return per_key.select(
        "qid", "key", F.size("_given").cast("bigint").alias("n_answers"), F.size(right).cast("bigint").alias("n_key_ok"),
        F.array_join(F.array_sort(right), ",").alias("right_systems"), F.map_from_entries("_given").alias("given"), *about,
    )


def header_totals(bank: DataFrame, scored: DataFrame) -> DataFrame:
    """Documents and questions with a result, domains, evaluated cells and the leading system."""
    rows = dashboard_rows(scored)
    asked = rows.join(bank.select("qid"), "qid", "left_semi")
    totals = asked.agg(
        F.count_distinct("doc").alias("n_docs"),
        F.count_distinct("qid").alias("n_questions"),
    )
    best = system_summary(rows).agg(F.struct(
        F.sum("q_tot").cast("bigint").alias("n_cells"),
        F.max_by("parser", F.struct(F.round("field_pct", 1), "parser")).alias("top_parser"),
    ).alias("best"))
    domains = bank.agg(F.count_distinct(F.nullif("domain", F.lit(""))).alias("n_domains"))
    # One-row results, put side by side as scalars.
    both = totals.withColumns({"n_domains": domains.scalar(), "_best": best.scalar()})
    return both.select("*", "_best.*").drop("_best")


def general_accuracy(outcomes: DataFrame) -> DataFrame:
    """Share of all gold fields that are right, per system."""
    return outcomes.groupBy("parser").agg(
        share(count_if(F.col("status") == "correct"), F.count("*")).alias("general_field_acc")
    )


def strict_accuracy(bank: DataFrame, scored: DataFrame, systems) -> DataFrame:
    """Share of all questions whose row matches fully; cells without a row count as wrong."""
    rows = across_systems(bank.select("qid"), systems).join(
        scored.select("qid", "parser", "match"), ["qid", "parser"], "left"
    )
    return rows.groupBy("parser").agg(strict_share())


def strict_share() -> Column:
    return share(count_if(F.coalesce("match", F.lit(False))), F.count("*")).alias("strict_question_acc")


def error_class(has_row: Column) -> Column:
    return (
        F.when(~has_row, "missing")
        .when(F.col("error_class").isNotNull(), F.col("error_class"))
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("has_answer"), "none")
        .otherwise("unknown")
    )


def stored_construction(scored: DataFrame) -> DataFrame:
    """Accuracy from stored verdicts over rows without any error; null golds are left as stored."""
    ok = scored.where(error_class(F.lit(True)) == "none")
    sums = ok.groupBy("parser").agg(*score_sums())
    return sums.select(
        "parser",
        share(F.col("field_ok"), F.col("field_tot")).alias("field_share"),
        share(F.col("q_ok"), F.col("q_tot")).alias("question_share"),
        F.col("q_tot").alias("n_ok"),
    )


def error_class_counts(bank: DataFrame, scored: DataFrame, systems) -> DataFrame:
    """Cells of the current bank per error class, absent rows as ``missing``."""
    rows = across_systems(bank.select("qid"), systems).join(
        scored.select(
            "qid", "parser", "error", "error_class", "has_answer", F.lit(True).alias("has_row")
        ),
        ["qid", "parser"],
        "left",
    )
    cls = error_class(F.coalesce("has_row", F.lit(False)))
    return rows.groupBy("parser", cls.alias("class")).agg(F.count("*").alias("n"))


def class_balance(golds: DataFrame) -> DataFrame:
    """Always-true, always-false and majority predictors over boolean gold fields."""
    n = F.count("*")
    t = count_if(F.coalesce("gold_true", F.lit(False)))
    always_true, always_false = share(t, n), share(n - t, n)
    return golds.agg(
        t.alias("n_true"),
        (n - t).alias("n_false"),
        always_true.alias("always_true"),
        always_false.alias("always_false"),
        F.greatest(always_true, always_false).alias("majority"),
    )


def boolean_golds(bank: DataFrame) -> DataFrame:
    """(qid, key, doc, gold_true) of the checkbox bucket's boolean fields."""
    return (
        bank.where(has_any_tag(F.col("capabilities"), CHECKBOX_TAGS))
        .select("qid", "doc", F.explode("fields").alias("field"))
        .where(F.col("field.gold_kind") == "bool")
        .select("qid", "doc", F.col("field.key").alias("key"), "field.gold_true")
    )


def majority_leg(golds: DataFrame, name: str = "majority") -> DataFrame:
    """The majority predictor as one more leg of outcomes; a tie predicts true."""
    balance = class_balance(golds)
    says_true = balance.select(F.col("n_true") >= F.col("n_false")).scalar()
    return golds.select(
        F.lit(name).alias("parser"),
        "qid", "key", "doc",
        F.lit("bool").alias("gold_kind"),
        "gold_true",
        F.when(F.col("gold_true") == says_true, "correct").otherwise("incorrect").alias("status"),
    )


def domain_buckets(bank: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("domain", F.lit("")), F.lit("(none)"))
    return bank.select(name.alias("bucket"), "qid").distinct()


def top_capability_buckets(bank: DataFrame, top: int = 12) -> DataFrame:
    """The ``top`` tags by number of questions, ties by name, as (bucket, qid)."""
    tags = bank.select(F.explode(F.array_distinct("capabilities")).alias("bucket"), "qid")
    sizes = tags.groupBy("bucket").agg(F.count_distinct("qid").alias("n_qs"))
    kept = sizes.orderBy(F.desc("n_qs"), "bucket").limit(top).select("bucket")
    return tags.join(kept, "bucket", "left_semi").distinct()


def bucket_order(bank: DataFrame, axis: str = "capability", top: int = 12) -> DataFrame:
    """Buckets of a breakdown with their sizes, largest first."""
    pairs = domain_buckets(bank) if axis == "domain" else top_capability_buckets(bank, top)
    return (
        pairs.groupBy("bucket").agg(F.count("*").alias("n_qs")).orderBy(F.desc("n_qs"), "bucket")
    )


def breakdown(outcomes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Accuracy, fields and documents per (system, bucket)."""
    rows = outcomes.join(buckets, "qid")
    return rows.groupBy("parser", "bucket").agg(
        share(count_if(F.col("status") == "correct"), F.count("*")).alias("acc"),
        F.count("*").alias("n"),
        F.count_distinct("doc").alias("d"),
    )


def row_coverage(bank: DataFrame, scored: DataFrame, systems) -> DataFrame:
    """Stored rows that belong to the current bank, against the number expected."""
    rows = across_systems(bank.select("qid"), systems).join(
        scored.select("qid", "parser", F.lit(True).alias("has_row")), ["qid", "parser"], "left"
    )
    return rows.groupBy("parser").agg(*coverage())


def coverage() -> list[Column]:
    seen = count_if(F.col("has_row").isNotNull())
    return [
        seen.alias("n_seen"),
        F.count("*").alias("n_expected"),
        (seen < F.count("*")).alias("incomplete"),
    ]


def parse_run_summary(meta: DataFrame) -> DataFrame:
    """Per system: documents, fine, failed, cached, median latency of fresh rows, cost per document.

    The median is the upper middle value, found by distributed selection.
    """
    fresh = meta.where(F.col("ok") & ~F.col("cached") & F.col("latency_sec").isNotNull())
    ranked = rank_values(fresh, ["parser"], "latency_sec", {"median_latency": lambda n: F.floor(n / 2)})
    counts = meta.groupBy("parser").agg(
        F.count("*").alias("n_docs"),
        count_if(F.col("ok")).alias("n_ok"),
        count_if(~F.col("ok")).alias("n_fail"),
        count_if(F.col("cached")).alias("n_cached"),
        share(
            F.coalesce(F.sum(F.when(F.col("ok"), F.col("cost_usd"))), F.lit(0.0)),
            count_if(F.col("ok")),
        ).alias("cost_per_doc"),
    )
    return counts.join(ranked, "parser", "left").withColumn("median_latency", F.coalesce("median_latency", F.lit(0.0)))


def bucket_overlap(bank: DataFrame) -> DataFrame:
    """Questions in the checkbox bucket, the blank bucket and both."""
    c = has_any_tag(F.col("capabilities"), CHECKBOX_TAGS)
    b = has_any_tag(F.col("capabilities"), BLANK_TAGS)
    return bank.agg(
        count_if(c).alias("checkbox"), count_if(b).alias("blank"), count_if(c & b).alias("overlap")
    )


def usage_summary(usage: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, truncated median, mean, max and the value at rank ``floor(0.95 n)``."""
    base = usage.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
    )
    ranks = rank_values(
        usage, by, value, MIDDLE | {"p95": lambda n: F.least(F.floor(n * 95 / F.lit(100)), n - 1)}
    )
    p50 = F.floor((F.col("_low") + F.col("_high")) / 2)
    return join_same(base, ranks.select(*by, p50.alias("p50"), "p95"), by)


def usage_by_domain(usage: DataFrame, value: str, domain: str = "domain") -> DataFrame:
    """Calls per domain with their mean, least and greatest use; an unnamed domain is ``?``."""
    return usage.groupBy(F.coalesce(domain, F.lit("?")).alias(domain)).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def stop_reasons(usage: DataFrame, by: list[str], reason: str = "stop") -> DataFrame:
    """Calls per stop reason (none is the empty text), with how many of them were parsed."""
    return usage.groupBy(*by, F.coalesce(reason, F.lit("")).alias(reason)).agg(
        F.count("*").alias("n"), count_if(F.coalesce("parsed", F.lit(False))).alias("n_parsed")
    )


def tag_prevalence(bank: DataFrame) -> DataFrame:
    """Questions per capability tag, with their share of the bank and of the checkbox bucket."""
    in_box = has_any_tag(F.col("capabilities"), CHECKBOX_TAGS)
    asked = bank.select(
        "qid", in_box.alias("in_box"), F.explode(F.array_distinct("capabilities")).alias("tag")
    )
    totals = bank.agg(F.struct(F.count("*").alias("n"), count_if(in_box).alias("b")).alias("t"))
    t = totals.scalar()
    return asked.groupBy("tag").agg(
        F.count("*").alias("n_qs"),
        count_if(F.col("in_box")).alias("n_box"),
    ).select(
        "tag", "n_qs",
        share(F.col("n_qs"), t["n"]).alias("bank_share"),
        share(F.col("n_box"), t["b"]).alias("bucket_share"),
    )


def attribute_crosstab(rows: DataFrame, documents: DataFrame, attribute: str) -> DataFrame:
    """Questions per document attribute, with the share of all questions."""
    counted = rows.join(documents.select("doc", attribute), "doc").groupBy(attribute).agg(
        F.count("*").alias("n_qs"), F.count_distinct("doc").alias("n_docs")
    )
    total = F.sum("n_qs").over(Window.partitionBy())
    return counted.withColumn("share", share(F.col("n_qs"), total))
