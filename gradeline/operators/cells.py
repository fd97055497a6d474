"""Cells: one (question, system) pair. Joining, scoring, planning and bookkeeping.

Tables
    bank     qid, doc, domain, capabilities array<string>,
             fields array<struct<key, gold VARIANT, is_string, ...>>   one row per question
    answers  qid, parser, answer VARIANT, has_answer, error, ...       one row per cell
    scored   qid, parser, has_answer, is_object, error, error_class,
             field_matches map<string,boolean>, null_keys array<string>, match
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.compare import leaf_form, value_kind, with_verdict


def answer_map(answer: Column) -> Column:
    """The top level of an object answer as ``map<string,variant>``; NULL for anything else."""
    return F.when(
        value_kind(answer) == "dict", F.try_variant_get(answer, "$", "map<string,variant>")
    )


def across_systems(bank: DataFrame, systems) -> DataFrame:
    """Every question once per system.

    ``systems`` is a list of keys, or a DataFrame with a ``parser`` column; the set of systems is
    a run setting of at most a few hundred names, so it travels as one array value in each task
    and the bank is expanded in place, without a shuffle.
    """
    if isinstance(systems, DataFrame):
        names = systems.agg(F.array_sort(F.collect_set("parser"))).scalar()
    else:
        names = F.array(*[F.lit(s) for s in systems])
    return bank.withColumn("parser", F.explode(names))


def cells(bank: DataFrame, scored: DataFrame, systems) -> DataFrame:
    """Every (question, system) with its stored row where one exists; one row per cell.

    The join key (qid, parser) is unique on both sides, so no hot question or system can load one
    task.
    """
    own = [c for c in scored.columns if c == "qid" or c not in bank.columns]
    return across_systems(bank, systems).join(scored.select(*own), ["qid", "parser"], "left")


def field_outcomes(bank: DataFrame, scored: DataFrame, systems) -> DataFrame:
    """One row per (system, question, gold key) with status ``correct``/``incorrect``/``error``.

    A stored error wins over a stored answer. A null gold is right only when the key is present
    with an explicit null; a key left out does not earn it.
    """
    stored = scored.select(
        "qid", "parser", "error", "has_answer", "is_object", "field_matches", "null_keys",
        F.lit(True).alias("has_row"),
    )
    return expand_outcomes(cells(bank, stored, systems)).drop("at")


def expand_outcomes(rows: DataFrame, *carry: str, outer: bool = False) -> DataFrame:
    """:func:`field_outcomes` of joined cells, with the place ``at`` of each gold key.

    ``carry`` names columns of the cell that go along with each field; with ``outer`` a cell without
    gold fields keeps one row, whose ``at`` is NULL.
    """
    rows = rows.withColumn(
        "scorable",
        F.coalesce(
            F.col("has_row") & F.col("error").isNull() & F.col("has_answer") & F.col("is_object"),
            F.lit(False),
        ),
    )
    keep = [c for c in ("doc", "domain", "capabilities") if c in rows.columns]
    expand = F.posexplode_outer if outer else F.posexplode
    flat = rows.select(
        "parser", "qid", *keep, *carry, "scorable", "field_matches", "null_keys",
        expand("fields").alias("at", "field"),
    )
    key = F.col("field.key")
    hit = F.when(
        F.col("field.gold_kind") == "null", F.array_contains("null_keys", key)
    ).otherwise(F.element_at("field_matches", key))
    status = (
        F.when(~F.col("scorable"), "error")
        .when(F.coalesce(hit, F.lit(False)), "correct")
        .otherwise("incorrect")
    )
    return flat.select(
        "parser", "qid", key.alias("key"), *keep, *carry,
        F.col("field.gold_kind").alias("gold_kind"),
        F.col("field.gold_true").alias("gold_true"),
        status.alias("status"), "at",
    )


def score_fields(bank: DataFrame, answers: DataFrame) -> DataFrame:
    """Long form of the typed score: one verdict per (qid, parser, gold key).

    Bank and answers meet on ``qid``; fields are expanded after the join. A key that the answer
    lacks, or an answer that is no object, compares as null.
    """
    form = lambda f: F.struct(f["key"], leaf_form(f["gold"]).alias("gold"), f["is_string"])
    gold = bank.select("qid", F.transform("fields", form).alias("fields"))
    joined = answers.where("has_answer").withColumn("amap", answer_map(F.col("answer"))).join(
        gold, "qid"
    )
    made = {"qid", "parser", "answer", "is_object", "field_matches", "null_keys", "match"}
    carry = [c for c in answers.columns if c not in made]
    flat = joined.select("qid", "parser", *carry, "amap", F.explode("fields").alias("field"))
    flat = flat.select(
        "qid", "parser", *carry,
        F.col("field.key").alias("key"),
        F.col("field.gold").alias("gold"),
        F.col("field.is_string").alias("is_string"),
        F.element_at("amap", F.col("field.key")).alias("value"),
        F.coalesce(F.map_contains_key("amap", F.col("field.key")), F.lit(False)).alias("present"),
        F.col("amap").isNotNull().alias("is_object"),
    )
    return with_verdict(flat, "value", "gold", "is_string", "ok")


def score_cells(bank: DataFrame, answers: DataFrame, *, carry: list[str] = ()) -> DataFrame:
    """Typed score per cell: ``field_matches``, ``null_keys`` and ``match`` (non-empty, all true).

    ``carry`` names columns of the answers that go along.

    The grouping keys extend the join key, so the rows are already where they need to be and no
    second shuffle happens.
    """
    per_field = score_fields(bank, answers)
    entry = F.struct("key", "ok")
    return per_field.groupBy("qid", "parser").agg(
        F.map_from_entries(F.collect_list(entry)).alias("field_matches"),
        F.array_compact(
            F.collect_list(
                F.when(F.col("present") & (value_kind(F.col("value")) == "null"), F.col("key"))
            )
        ).alias("null_keys"),
        F.bool_and("is_object").alias("is_object"),
        F.bool_and("ok").alias("match"),
        *[F.any_value(c).alias(c) for c in carry],
    )


def rescore(bank: DataFrame, stored: DataFrame) -> DataFrame:
    """Score stored answers again; rows with an ``answer`` key take part, even a null answer.

    Returns new verdicts with ``changed`` telling rows whose stored verdict differs, so that only
    their partitions need a rewrite.
    """
    old = {"old_matches": "field_matches", "old_match": "match"}
    rows = stored.select("qid", "parser", "answer", "has_answer", *[F.col(c).alias(n) for n, c in old.items()])
    fresh = score_cells(bank, rows, carry=list(old))
    entries = lambda m: F.array_sort(F.map_entries(m))
    return fresh.withColumn(
        "changed",
        ~(
            entries(F.col("field_matches")).eqNullSafe(entries(F.col("old_matches")))
            & F.col("match").eqNullSafe(F.col("old_match"))
        ),
    )


def rescore_counts(bank: DataFrame, stored: DataFrame) -> DataFrame:
    """Per system: rows examined, skipped (not in the bank, or no answer key) and changed."""
    return change_counts(stored, rescore(bank, stored))


def change_counts(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """:func:`rescore_counts` of stored rows and the verdicts of :func:`rescore`."""
    seen = stored.groupBy("parser").agg(F.count("*").alias("examined"))
    done = verdicts.groupBy("parser").agg(
        F.count("*").alias("_scored"), F.count_if("changed").alias("changed")
    )
    zero = F.lit(0).cast("bigint")
    return seen.join(done, "parser", "left").select(
        "parser", "examined",
        (F.col("examined") - F.coalesce("_scored", zero)).alias("skipped"),
        F.coalesce("changed", zero).alias("changed"),
    )


def mismatch_context(
    bank: DataFrame, scored: DataFrame, *, system_contains: str = "", limit: int | None = None
) -> DataFrame:
    """Stored rows that do not fully match, with the question's document and domain."""
    rows = scored.where(
        F.col("parser").contains(system_contains) & ~F.coalesce("match", F.lit(False))
    )
    out = rows.join(bank.select("qid", "doc", "domain"), "qid", "left")
    if limit is not None:
        out = out.orderBy("parser", "qid").limit(limit)
    return out


def with_transcript(bank: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Questions whose document has a transcript."""
    return bank.join(transcripts.select("doc"), "doc", "left_semi")


def pending_cells(bank: DataFrame, stored: DataFrame, systems) -> DataFrame:
    """Cells that have no stored row yet."""
    return across_systems(bank.select("qid", "doc"), systems).join(
        stored.select("qid", "parser"), ["qid", "parser"], "left_anti"
    )


def plan_counts(bank: DataFrame, stored: DataFrame, systems) -> DataFrame:
    """Per system: cells to run, cached and fine, cached but failed (unreadable rows too)."""
    have = stored.select("qid", "parser", F.lit(True).alias("cached"), "error_class")
    rows = across_systems(bank.select("qid"), systems).join(have, ["qid", "parser"], "left")
    fine = F.coalesce(F.col("error_class") == "none", F.lit(False))
    return rows.groupBy("parser").agg(
        F.count_if(F.col("cached").isNull()).alias("pending"),
        F.count_if(F.col("cached") & fine).alias("cached_ok"),
        F.count_if(F.col("cached") & ~fine).alias("cached_error"),
    )


def cell_states(
    bank: DataFrame, stored: DataFrame, transcripts: DataFrame, systems
) -> DataFrame:
    """What a scoring pass would do with each cell.

    An answer is scored again, even beside an error; an error other than "no answer" is final;
    without a transcript the cell fails; anything else is pending.
    """
    rows = across_systems(bank.select("qid", "doc"), systems)
    rows = rows.join(
        stored.select("qid", "parser", "has_answer", "error"), ["qid", "parser"], "left"
    )
    have = transcripts.select("parser", "doc", F.lit(True).alias("has_transcript"))
    rows = rows.join(have, ["parser", "doc"], "left")
    state = (
        F.when(F.coalesce("has_answer", F.lit(False)), "rescore")
        .when(F.col("error").isNotNull() & ~F.col("error").contains("no answer"), "terminal_error")
        .when(F.col("has_transcript").isNull(), "transcript_missing")
        .otherwise("pending")
    )
    return rows.select("qid", "parser", state.alias("state"))


def parse_completeness(
    transcripts: DataFrame, meta: DataFrame, *, force: bool = False, retry_errors: bool = False
) -> DataFrame:
    """Which (system, document) parses are done.

    Done needs a transcript and a metadata row. A failed one counts as done unless errors are
    to be tried again; ``force`` leaves nothing done.
    """
    t = transcripts.select("parser", "doc", F.lit(True).alias("has_text"))
    m = meta.select("parser", "doc", F.lit(True).alias("has_meta"), "ok")
    rows = t.join(m, ["parser", "doc"], "full_outer")
    done = F.col("has_text").isNotNull() & F.col("has_meta").isNotNull()
    if retry_errors:
        done = done & F.coalesce("ok", F.lit(False))
    if force:
        done = F.lit(False)
    return rows.select("parser", "doc", done.alias("done"))


def section_of(parser: Column, no_image: Column) -> Column:
    """Report section of a system key, from its prefix and the control flag alone."""
    return (
        F.when(parser.startswith("vlm__") & F.coalesce(no_image, F.lit(False)), "no_image")
        .when(parser.startswith("vlm__"), "direct")
        .otherwise("transcriber")
    )


def paired_legs(outcomes: DataFrame, first: str, second: str, by: list[str] = ()) -> DataFrame:
    """Fields two legs both answered for, split into both / only one / neither right."""
    keys = ["qid", "key"]
    right = F.col("status") == "correct"
    a = outcomes.where(F.col("parser") == first).select(*keys, *by, right.alias("a_ok"))
    b = outcomes.where(F.col("parser") == second).select(*keys, right.alias("b_ok"))
    rows = a.join(b, keys)
    counts = [
        F.count_if(F.col("a_ok") & F.col("b_ok")).alias("both"),
        F.count_if(F.col("a_ok") & ~F.col("b_ok")).alias("a_only"),
        F.count_if(~F.col("a_ok") & F.col("b_ok")).alias("b_only"),
        F.count_if(~F.col("a_ok") & ~F.col("b_ok")).alias("neither"),
    ]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def split_generation(stored: DataFrame, current: str) -> DataFrame:
    """Where a row goes when the extractor changes: direct rows stay, others are archived.

    Unreadable rows (no system key) are archived under ``unreadable``.
    """
    parser = F.col("parser")
    stays = F.coalesce(parser.startswith("vlm__"), F.lit(False))
    older = F.coalesce(F.col("extractor"), F.lit("unstamped"))
    generation = (
        F.when(stays, F.lit(current)).when(parser.isNull(), "unreadable").otherwise(older)
    )
    return stored.withColumn("archived", ~stays).withColumn("generation", generation)


def archive_collisions(split: DataFrame, archive: DataFrame) -> DataFrame:
    """Rows to archive whose place is taken; the move may start only when this is empty."""
    return split.where("archived").join(
        archive.select("qid", "parser", "generation"), ["qid", "parser", "generation"], "left_semi"
    )
