"""Queries over cells, field outcomes and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.operators import cells, metrics
from gradeline.plans import relations as rel
from gradeline.plans.catalog import query
from gradeline.plans.relations import SYSTEMS, with_relations

R6 = lambda *names: {n: F.round(F.col(n), 6) for n in names}

BLOCK = """count(*) AS n, count(*) FILTER (WHERE status <> 'error') AS n_answered,
  round(count(*) FILTER (WHERE status = 'correct') / count(*), 6) AS acc_over_all,
  round(coalesce(count(*) FILTER (WHERE status = 'correct')
    / nullif(count(*) FILTER (WHERE status <> 'error'), 0), 0), 6) AS acc_over_answered,
  round(count(*) FILTER (WHERE status = 'error') / count(*), 6) AS error_rate"""
BLOCK_COLS = ("acc_over_all", "acc_over_answered", "error_rate")


def outcomes(spark, sf):
    return cells.field_outcomes(rel.bank(spark, sf), rel.scored(spark, sf), SYSTEMS)


def buckets(spark):
    """Capability buckets; the last uses a tag that no question carries."""
    from gradeline.sources.dimensions import capability_buckets

    return capability_buckets(
        spark,
        [
            ("Checkboxes", ["checkbox_state", "form_checkbox_grid", "handdrawn_check"], "marks"),
            ("Blanks", ["blank_field"], "left empty"),
            ("Tables", ["table"], "cells"),
            ("Handwriting", ["handwriting", "handdrawn_check"], "written"),
            ("Stamps", ["stamp_text"], "unused tag"),
        ],
    )


SQL_BUCKETS = """SELECT * FROM (VALUES (0, 'Checkboxes', 'checkbox_state'),
  (0, 'Checkboxes', 'form_checkbox_grid'), (0, 'Checkboxes', 'handdrawn_check'),
  (1, 'Blanks', 'blank_field'), (2, 'Tables', 'table'), (3, 'Handwriting', 'handwriting'),
  (3, 'Handwriting', 'handdrawn_check'), (4, 'Stamps', 'stamp_text')) v(ord, name, tag)"""
SQL_BUCKET_MAP = "SELECT DISTINCT ord, name, qid FROM tags JOIN bucket_tags USING (tag)"
SQL_SHOWN = "SELECT * FROM rows WHERE has_answer AND error IS NULL"


# -- scoring -----------------------------------------------------------------------------------


@query(
    "C04_score_cells",
    with_relations(
        "rows",
        """SELECT r.parser, count(*) AS n_cells, CAST(sum(n_fields) AS BIGINT) AS n_fields,
             CAST(sum(n_matched) AS BIGINT) AS n_matched,
             count(*) FILTER (WHERE match) AS n_match, CAST(sum(nn) AS BIGINT) AS n_null_keys
           FROM rows r JOIN (SELECT q, p, count(*) FILTER (WHERE NOT junk AND NOT absent AND
             CASE WHEN wrong THEN kind <> 'null' AND pk % 3 = 0 ELSE kind = 'null' END) AS nn
             FROM marks GROUP BY q, p) k ON k.q = r.q AND k.p = r.p
           WHERE has_answer GROUP BY r.parser""",
    ),
)
def score_cells(spark, sf):
    got = cells.score_cells(rel.bank(spark, sf, with_gold=True), rel.answers(spark, sf))
    return got.groupBy("parser").agg(
        F.count("*").alias("n_cells"),
        F.sum(F.size("field_matches")).cast("bigint").alias("n_fields"),
        F.sum(metrics.true_values(F.col("field_matches"))).cast("bigint").alias("n_matched"),
        F.count_if("match").alias("n_match"),
        F.sum(F.size("null_keys")).cast("bigint").alias("n_null_keys"),
    )


@query(
    "C04_field_verdicts",
    with_relations(
        "marks",
        """SELECT parser, qid, key,
             CASE WHEN junk OR absent THEN kind = 'null' ELSE NOT wrong END AS ok
           FROM marks WHERE NOT missing AND has_answer""",
    ),
)
def field_verdicts(spark, sf):
    return cells.score_fields(
        rel.bank(spark, sf, with_gold=True), rel.answers(spark, sf)
    ).select("parser", "qid", "key", "ok")


@query(
    "C05_rescore",
    with_relations(
        "rows",
        """SELECT parser, count(*) AS examined, count(*) FILTER (WHERE NOT has_answer) AS skipped,
             count(*) FILTER (WHERE has_answer AND q % 13 = 0 AND match) AS changed
           FROM rows GROUP BY parser""",
    ),
)
def rescore(spark, sf):
    # Stored verdicts of an older rule: some questions were stored as not matching.
    old = rel.stored(spark, sf).withColumn(
        "match", F.col("match") & ~(F.col("q") % 13 == 0)
    )
    stored = old.select("qid", "parser", "field_matches", "match", "has_answer", "answer")
    return cells.rescore_counts(rel.bank(spark, sf, with_gold=True), stored)


# -- joins, plans, bookkeeping -----------------------------------------------------------------


@query(
    "J01_gold_by_system",
    with_relations(
        "fields",
        """SELECT parser, count(*) AS n_fields, count(*) FILTER (WHERE missing) AS n_missing,
             count(DISTINCT qid) AS n_questions FROM fields GROUP BY parser""",
    ),
)
def gold_by_system(spark, sf):
    rows = cells.cells(
        rel.bank(spark, sf), rel.scored(spark, sf).select("qid", "parser", "has_answer"), SYSTEMS
    )
    return rows.groupBy("parser").agg(
        F.sum(F.size("fields")).cast("bigint").alias("n_fields"),
        F.sum(F.when(F.col("has_answer").isNull(), F.size("fields")).otherwise(0))
        .cast("bigint").alias("n_missing"),
        F.count("*").alias("n_questions"),
    )


@query(
    "J02_mismatch_context",
    with_relations(
        "rows",
        """SELECT parser, qid, doc, domain FROM rows
           WHERE contains(parser, 'cloud') AND NOT (has_answer AND match)""",
    ),
)
def mismatch_context(spark, sf):
    bank = rel.bank(spark, sf)
    stored = rel.scored(spark, sf).drop("doc", "domain")
    return cells.mismatch_context(bank, stored, system_contains="cloud").select(
        "parser", "qid", "doc", "domain"
    )


@query(
    "J03_with_transcript",
    with_relations(
        "asked",
        """SELECT qid, doc FROM asked WHERE d IN (SELECT doc_id FROM documents)""",
    ),
)
def with_transcript(spark, sf):
    have = rel.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc")
    )
    return cells.with_transcript(rel.bank(spark, sf).select("qid", "doc"), have).select(
        "qid", "doc"
    )


@query(
    "J04_pending_cells",
    with_relations("cells", "SELECT qid, parser FROM cells WHERE missing"),
)
def pending_cells(spark, sf):
    return cells.pending_cells(rel.bank(spark, sf), rel.scored(spark, sf), SYSTEMS).select(
        "qid", "parser"
    )


@query(
    "J04_plan_counts",
    with_relations(
        "cells",
        """SELECT parser, count(*) FILTER (WHERE missing) AS pending,
             count(*) FILTER (WHERE NOT missing AND NOT failed AND p < 3) AS cached_ok,
             count(*) FILTER (WHERE NOT missing AND (failed OR p >= 3)) AS cached_error
           FROM cells GROUP BY parser""",
    ),
)
def plan_counts(spark, sf):
    return cells.plan_counts(rel.bank(spark, sf), rel.scored(spark, sf), SYSTEMS)


def transcript_index(spark, sf):
    """(parser, doc) pairs with a transcript: a leg misses the documents of one sales segment."""
    customers = rel.table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc"), "c_nationkey"
    )
    every = cells.across_systems(customers, SYSTEMS)
    leg = F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("parser"))
    return every.where(F.col("c_nationkey") != leg).select("parser", "doc", "c_nationkey")


SQL_TRANSCRIPTS = (
    "SELECT 'd' || c_custkey AS doc, p, c_nationkey FROM "
    "(SELECT *, unnest(range(0, 6)) AS p FROM customer) WHERE c_nationkey <> p + 1"
)


@query(
    "J05_cell_states",
    with_relations(
        "cells",
        """SELECT c.parser, state, count(*) AS n FROM (SELECT c.*, CASE
             WHEN NOT missing AND has_answer THEN 'rescore'
             WHEN NOT missing AND failed AND q % 3 <> 1 THEN 'terminal_error'
             WHEN t.doc IS NULL THEN 'transcript_missing' ELSE 'pending' END AS state
             FROM cells c LEFT JOIN transcripts t ON t.doc = c.doc AND t.p = c.p) c
           GROUP BY c.parser, state""",
        transcripts=SQL_TRANSCRIPTS,
    ),
)
def cell_states(spark, sf):
    states = cells.cell_states(
        rel.bank(spark, sf), rel.scored(spark, sf), transcript_index(spark, sf), SYSTEMS
    )
    return states.groupBy("parser", "state").agg(F.count("*").alias("n"))


def parse_meta(spark, sf):
    """Parse metadata per (system, document): one order-free function of customer and system."""
    rows = cells.across_systems(
        rel.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), SYSTEMS
    ).withColumn("p", F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("parser")) - 1)
    c, p = F.col("c_custkey"), F.col("p")
    ok = (c * 3 + p) % 17 != 0
    return rows.select(
        "parser",
        F.concat(F.lit("d"), c.cast("string")).alias("doc"),
        ok.alias("ok"),
        ((c + p) % 4 == 0).alias("cached"),
        ((c % 3) + 1).cast("bigint").alias("page_count"),
        F.when((c + p) % 19 != 0, ((c * 7 + p * 5) % 1000) / F.lit(100.0)).alias("latency_sec"),
        # System 3 never recorded a cost, system 4 has no rate, both wrote zero.
        F.when(p.isin(3, 4), F.lit(0.0)).when(ok, ((c * 11 + p) % 97) / F.lit(1000.0))
        .otherwise(F.lit(0.0)).alias("cost_usd"),
        ((c * 13 + p * 3) % 4000).cast("bigint").alias("md_length"),
        "p",
    )


SQL_META = """SELECT p, CASE p WHEN 0 THEN 'vlm__alpha-8b@cloud__0a1b2c3d4e5f'
    WHEN 1 THEN 'vlm__beta-xl@cloud__0a1b2c3d4e5f' WHEN 2 THEN 'vlm__beta-xl@cloud__ffee00112233'
    WHEN 3 THEN 'alpha-ocr_cloud__0a1b2c3d4e5f' WHEN 4 THEN 'scanner_pro' ELSE 'mystery_ocr' END
    AS parser, c_custkey AS c, 'd' || c_custkey AS doc, (c_custkey * 3 + p) % 17 <> 0 AS ok,
    (c_custkey + p) % 4 = 0 AS cached, (c_custkey % 3) + 1 AS page_count,
    CASE WHEN (c_custkey + p) % 19 <> 0 THEN ((c_custkey * 7 + p * 5) % 1000) / 100.0::DOUBLE END
      AS latency_sec,
    CASE WHEN p IN (3, 4) THEN 0.0 WHEN (c_custkey * 3 + p) % 17 <> 0
         THEN ((c_custkey * 11 + p) % 97) / 1000.0::DOUBLE ELSE 0.0 END AS cost_usd,
    (c_custkey * 13 + p * 3) % 4000 AS md_length
  FROM (SELECT *, unnest(range(0, 6)) AS p FROM customer)"""


@query(
    "J06_parse_completeness",
    with_relations(
        "",
        """SELECT coalesce(t.doc, m.doc) AS doc, coalesce(t.p, m.p) AS p,
             t.doc IS NOT NULL AND m.ok IS NOT NULL AND coalesce(m.ok, false) AS done
           FROM transcripts t FULL JOIN meta m ON t.doc = m.doc AND t.p = m.p""",
        meta=SQL_META,
        transcripts=SQL_TRANSCRIPTS,
    ),
)
def parse_completeness(spark, sf):
    done = cells.parse_completeness(
        transcript_index(spark, sf), parse_meta(spark, sf), retry_errors=True
    )
    p = F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("parser")) - 1
    return done.select("doc", p.cast("bigint").alias("p"), "done")


@query(
    "J07_sections",
    with_relations(
        "rows",
        """SELECT CASE WHEN p = 2 THEN 'no_image' WHEN p < 2 THEN 'direct' ELSE 'transcriber' END
             AS section, count(DISTINCT parser) AS n_systems, count(*) AS n_rows
           FROM rows GROUP BY 1""",
    ),
)
def sections(spark, sf):
    rows = rel.scored(spark, sf).withColumn("no_image", F.col("parser").endswith("ffee00112233"))
    return rows.groupBy(
        cells.section_of(F.col("parser"), F.col("no_image")).alias("section")
    ).agg(
        F.count_distinct("parser").alias("n_systems"), F.count("*").alias("n_rows")
    )


SQL_PAIRED = """SELECT a.domain, count(*) FILTER (WHERE a.ok AND b.ok) AS both,
    count(*) FILTER (WHERE a.ok AND NOT b.ok) AS a_only,
    count(*) FILTER (WHERE NOT a.ok AND b.ok) AS b_only,
    count(*) FILTER (WHERE NOT a.ok AND NOT b.ok) AS neither
  FROM (SELECT qid, key, domain, status = 'correct' AS ok FROM fields WHERE p = 0) a
  JOIN (SELECT qid, key, status = 'correct' AS ok FROM fields WHERE p = 3) b
  USING (qid, key) GROUP BY a.domain"""


@query("J09_paired_legs", with_relations("fields", SQL_PAIRED))
def paired_legs(spark, sf):
    return cells.paired_legs(outcomes(spark, sf), SYSTEMS[0], SYSTEMS[3], ["domain"])


@query(
    "J10_split_generation",
    with_relations(
        "rows",
        """SELECT CASE WHEN p < 3 THEN 'gen-2' WHEN q % 4 = 0 THEN 'unstamped' ELSE 'gen-1' END
             AS generation, p >= 3 AS archived, count(*) AS n,
             count(*) FILTER (WHERE p >= 3 AND q % 4 = 0 AND q % 9 = 0) AS n_collisions
           FROM rows GROUP BY 1, 2""",
    ),
)
def split_generation(spark, sf):
    stored = rel.scored(spark, sf).withColumn(
        "extractor", F.when(F.col("q") % 4 != 0, F.lit("gen-1"))
    )
    split = cells.split_generation(stored, "gen-2")
    taken = split.where("archived AND q % 4 = 0 AND q % 9 = 0").select(
        "qid", "parser", "generation"
    )
    clash = cells.archive_collisions(split, taken).groupBy("generation").agg(
        F.count("*").alias("n_collisions")
    )
    return (
        split.groupBy("generation", "archived").agg(F.count("*").alias("n"))
        .join(clash, "generation", "left")
        .select("generation", "archived", "n",
                F.coalesce("n_collisions", F.lit(0)).cast("bigint").alias("n_collisions"))
    )


# -- metrics -----------------------------------------------------------------------------------


@query(
    "A01_field_outcomes",
    with_relations("fields", "SELECT parser, qid, key, doc, kind AS gold_kind, status FROM fields"),
)
def field_outcomes(spark, sf):
    return outcomes(spark, sf).select("parser", "qid", "key", "doc", "gold_kind", "status")


@query(
    "A02_metric_block",
    with_relations("fields", f"SELECT parser, domain, {BLOCK} FROM fields GROUP BY parser, domain"),
)
def metric_block(spark, sf):
    return metrics.metric_block(outcomes(spark, sf), ["parser", "domain"]).withColumns(
        R6(*BLOCK_COLS)
    )


@query(
    "A03_checkbox_metrics",
    with_relations(
        "fields",
        f"""SELECT parser, {BLOCK},
             round(count(*) FILTER (WHERE gold_true AND status = 'correct')
               / count(*) FILTER (WHERE gold_true), 6) AS acc_checked,
             round(count(*) FILTER (WHERE NOT gold_true AND status = 'correct')
               / count(*) FILTER (WHERE NOT gold_true), 6) AS acc_unchecked,
             count(*) FILTER (WHERE gold_true AND status = 'correct') AS tt,
             count(*) FILTER (WHERE gold_true AND status = 'incorrect') AS tf,
             count(*) FILTER (WHERE NOT gold_true AND status = 'incorrect') AS ft,
             count(*) FILTER (WHERE NOT gold_true AND status = 'correct') AS ff,
             count(*) FILTER (WHERE status = 'error') AS err
           FROM fields WHERE checkbox AND kind = 'bool' GROUP BY parser""",
    ),
)
def checkbox_metrics(spark, sf):
    rows = metrics.boolean_gold(outcomes(spark, sf))
    return metrics.checkbox_metrics(rows, ["parser"]).withColumns(
        R6(*BLOCK_COLS, "acc_checked", "acc_unchecked")
    )


@query(
    "A04_null_metrics",
    with_relations(
        "fields",
        f"""SELECT parser, {BLOCK}, round(count(*) FILTER (WHERE status = 'incorrect')
             / count(*) FILTER (WHERE status <> 'error'), 6) AS hallucination_rate
           FROM fields WHERE kind = 'null' GROUP BY parser""",
    ),
)
def null_metrics(spark, sf):
    return metrics.null_metrics(metrics.null_gold(outcomes(spark, sf)), ["parser"]).withColumns(
        R6(*BLOCK_COLS, "hallucination_rate")
    )


SUMS = """CAST(sum(n_matched) AS BIGINT) AS field_ok, CAST(sum(n_fields) AS BIGINT) AS field_tot,
  count(*) FILTER (WHERE match) AS q_ok, count(*) AS q_tot"""
PCTS = """round(100 * sum(n_matched) / sum(n_fields), {d}) AS field_pct,
  round(100 * count(*) FILTER (WHERE match) / count(*), {d}) AS q_pct"""


@query(
    "A05_system_summary",
    with_relations(
        "rows", f"SELECT parser, {SUMS}, {PCTS.format(d=6)} FROM rows WHERE has_answer GROUP BY 1"
    ),
)
def system_summary(spark, sf):
    return metrics.system_summary(rel.scored(spark, sf)).withColumns(R6("field_pct", "q_pct"))


@query(
    "A06_dashboard_summary",
    with_relations(
        "rows",
        f"""SELECT parser, dom AS domain, CAST(grouping(dom) AS INTEGER) AS overall, {SUMS},
             {PCTS.format(d=1)}
           FROM (SELECT *, CASE domain WHEN '1-URGENT' THEN '2-HIGH' ELSE domain END AS dom
                 FROM shown) GROUP BY GROUPING SETS ((parser), (parser, dom))""",
        shown=SQL_SHOWN,
    ),
)
def dashboard_summary(spark, sf):
    return metrics.dashboard_summary(rel.scored(spark, sf), {"1-URGENT": "2-HIGH"})


@query(
    "A06_domain_matrix",
    with_relations(
        "rows",
        "SELECT parser, "
        + ", ".join(
            f"""coalesce(round(100 * sum(n_matched) FILTER (WHERE domain = '{d}')
              / sum(n_fields) FILTER (WHERE domain = '{d}'), 1), 0) AS "{d}" """
            for d in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
        )
        + " FROM shown GROUP BY parser",
        shown=SQL_SHOWN,
    ),
)
def domain_matrix(spark, sf):
    return metrics.domain_matrix(
        rel.scored(spark, sf), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    )


@query(
    "A07_bucket_scores",
    with_relations(
        "rows tags",
        f"""SELECT ord, name, parser, {SUMS}, {PCTS.format(d=1)}
           FROM shown JOIN bucket_map USING (qid) GROUP BY ord, name, parser""",
        bucket_tags=SQL_BUCKETS, bucket_map=SQL_BUCKET_MAP, shown=SQL_SHOWN,
    ),
)
def bucket_scores(spark, sf):
    return metrics.bucket_scores(rel.bank(spark, sf), rel.scored(spark, sf), buckets(spark))


VOTES = """SELECT qid, count(*) AS n_with, count(*) FILTER (WHERE match) AS n_right
  FROM shown GROUP BY qid"""


@query(
    "A08_discriminative_examples",
    with_relations(
        "rows tags",
        """SELECT ord, name, qid, n_with, n_right, score, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, qid) AS rank
             FROM (SELECT *, (n_with - n_right) * n_right AS score
                   FROM votes JOIN bucket_map USING (qid) WHERE n_with >= 5)) WHERE rank <= 6""",
        bucket_tags=SQL_BUCKETS, bucket_map=SQL_BUCKET_MAP, shown=SQL_SHOWN, votes=VOTES,
    ),
)
def discriminative_examples(spark, sf):
    return metrics.discriminative_examples(
        rel.bank(spark, sf), rel.scored(spark, sf), buckets(spark)
    ).withColumn("rank", F.col("rank").cast("bigint"))


# The stored answer of a field as JSON; NULL where the key or the whole object is missing.
SQL_GIVEN = r"""SELECT *, CASE WHEN junk OR absent THEN NULL
    WHEN CASE WHEN wrong THEN kind <> 'null' AND pk % 3 = 0 ELSE kind = 'null' END THEN 'null'
    WHEN wrong THEN CASE ln % 4 WHEN 0 THEN CASE flag WHEN 'R' THEN 'false' ELSE 'true' END WHEN 1 THEN (qty + 1)::VARCHAR
      WHEN 2 THEN '"crate ' || pk || ' to vendor ' || sk || ' mark unknown"' ELSE '"unreadable"' END
    ELSE CASE ln % 4 WHEN 0 THEN CASE flag WHEN 'R' THEN 'true' ELSE 'false' END
      WHEN 1 THEN CASE pk % 4 WHEN 0 THEN qty::VARCHAR WHEN 1 THEN '"$' || qty || '.00"' WHEN 2 THEN '"' || qty || '%"'
        ELSE '"' || regexp_replace(qty::VARCHAR, '(\d)', '\1 ', 'g') || '"' END
      ELSE CASE pk % 4 WHEN 0 THEN '"lot ' || pk || ' from supplier ' || sk || ' flag ' || flag || '"'
        WHEN 1 THEN '"**lot** ' || pk || ' from<br/>supplier ' || sk || ' flag ' || flag || '"'
        WHEN 2 THEN '"Lot ' || pk || ', from supplier ' || sk || ': Flag ' || flag || '."'
        ELSE '"lot  ' || pk || '   from supplier ' || sk || '  flag ' || flag || '"' END END END AS given FROM fields"""


@query(
    "A09_question_browser",
    with_relations(
        "rows fields",
        """SELECT f.qid, f.key, count(*) AS n_answers, count(*) FILTER (WHERE f.matched) AS n_key_ok,
             coalesce(string_agg(f.parser, ',' ORDER BY f.parser) FILTER (WHERE f.matched), '')
               AS right_systems,
             string_agg(f.parser || ' ' || f.matched || ' ' || coalesce(f.given, '-'), '; ' ORDER BY f.parser) AS given,
             any_value(v.n_with) AS n_parsers, any_value(v.n_right) AS n_correct,
             any_value(v.place) AS place, any_value(f.doc) AS doc, any_value(f.domain) AS domain
           FROM given f JOIN shown s ON s.q = f.q AND s.p = f.p JOIN placed v ON v.qid = f.qid
           GROUP BY f.qid, f.key""",
        given=SQL_GIVEN, shown=SQL_SHOWN, votes=VOTES,
        placed="SELECT *, row_number() OVER (ORDER BY n_right, qid) - 1 AS place FROM votes",
    ),
)
def question_browser(spark, sf):
    rows = metrics.question_browser(rel.bank(spark, sf), rel.scored(spark, sf), rel.answers(spark, sf))
    text = F.transform(
        F.array_sort(F.map_keys("given")),
        lambda p: F.concat_ws(
            " ", p, F.element_at("given", p)["right"].cast("string"),
            F.coalesce(F.to_json(F.element_at("given", p)["value"]), F.lit("-")),
        ),
    )
    return rows.withColumn("given", F.array_join(text, "; "))


@query(
    "A10_header_totals",
    with_relations(
        "rows",
        """SELECT count(DISTINCT doc) AS n_docs, count(DISTINCT qid) AS n_questions,
             (SELECT count(DISTINCT domain) FROM asked) AS n_domains, count(*) AS n_cells,
             (SELECT max_by(parser, (pct, parser)) FROM (SELECT parser,
               round(100 * sum(n_matched) / sum(n_fields), 1) AS pct FROM shown GROUP BY parser))
               AS top_parser FROM shown""",
        shown=SQL_SHOWN,
    ),
)
def header_totals(spark, sf):
    return metrics.header_totals(rel.bank(spark, sf), rel.scored(spark, sf))


@query(
    "A11_general_and_strict",
    with_relations(
        "fields rows",
        """SELECT f.parser, round(f.g, 6) AS general_field_acc, round(s.n / t.n, 6)
             AS strict_question_acc
           FROM (SELECT parser, count(*) FILTER (WHERE status = 'correct') / count(*) AS g
                 FROM fields GROUP BY parser) f
           JOIN (SELECT parser, count(*) FILTER (WHERE has_answer AND match) AS n FROM rows
                 GROUP BY parser) s ON s.parser = f.parser,
           (SELECT count(*) AS n FROM asked) t""",
    ),
)
def general_and_strict(spark, sf):
    bank, stored = rel.bank(spark, sf), rel.scored(spark, sf)
    general = metrics.general_accuracy(cells.field_outcomes(bank, stored, SYSTEMS))
    return general.join(metrics.strict_accuracy(bank, stored, SYSTEMS), "parser").withColumns(
        R6("general_field_acc", "strict_question_acc")
    )


@query(
    "A12_stored_construction",
    with_relations(
        "rows",
        """SELECT parser, round(sum(n_matched) / sum(n_fields), 6) AS field_share,
             round(count(*) FILTER (WHERE match) / count(*), 6) AS question_share,
             count(*) AS n_ok FROM rows WHERE NOT failed GROUP BY parser""",
    ),
)
def stored_construction(spark, sf):
    return metrics.stored_construction(rel.scored(spark, sf)).withColumns(
        R6("field_share", "question_share")
    )


SQL_ERROR_CLASS = """CASE WHEN missing THEN 'missing'
  WHEN p < 3 THEN CASE WHEN NOT failed THEN 'none' WHEN q % 2 = 0 THEN 'api_error'
    ELSE 'parse_error' END
  WHEN failed THEN 'error' ELSE 'none' END"""


@query(
    "A13_error_classes",
    with_relations(
        "cells", f"SELECT parser, {SQL_ERROR_CLASS} AS class, count(*) AS n FROM cells GROUP BY 1, 2"
    ),
)
def error_classes(spark, sf):
    return metrics.error_class_counts(rel.bank(spark, sf), rel.scored(spark, sf), SYSTEMS)


SQL_BALANCE = """SELECT count(*) FILTER (WHERE gold_true) AS n_true,
  count(*) FILTER (WHERE NOT gold_true) AS n_false,
  round(count(*) FILTER (WHERE gold_true) / count(*), 6) AS always_true,
  round(count(*) FILTER (WHERE NOT gold_true) / count(*), 6) AS always_false,
  round(greatest(count(*) FILTER (WHERE gold_true), count(*) FILTER (WHERE NOT gold_true))
    / count(*), 6) AS majority FROM gold WHERE checkbox AND kind = 'bool'"""


@query("A14_class_balance", with_relations("gold", SQL_BALANCE))
def class_balance(spark, sf):
    return metrics.class_balance(metrics.boolean_golds(rel.bank(spark, sf))).withColumns(
        R6("always_true", "always_false", "majority")
    )


@query(
    "A15_majority_leg",
    with_relations(
        "gold",
        """SELECT qid, key, doc, CASE WHEN gold_true = (SELECT count(*) FILTER (WHERE gold_true)
             >= count(*) FILTER (WHERE NOT gold_true) FROM gold WHERE checkbox AND kind = 'bool')
             THEN 'correct' ELSE 'incorrect' END AS status
           FROM gold WHERE checkbox AND kind = 'bool'""",
    ),
)
def majority_leg(spark, sf):
    return metrics.majority_leg(metrics.boolean_golds(rel.bank(spark, sf))).select(
        "qid", "key", "doc", "status"
    )


@query(
    "A16_breakdown_buckets",
    with_relations(
        "tags",
        """SELECT 'domain' AS axis, domain AS bucket, count(*) AS n_qs FROM asked GROUP BY domain
           UNION ALL SELECT * FROM (SELECT 'capability', tag, count(DISTINCT qid) AS n FROM tags
             GROUP BY tag ORDER BY n DESC, tag LIMIT 12)""",
    ),
)
def breakdown_buckets(spark, sf):
    bank = rel.bank(spark, sf)
    named = lambda axis: metrics.bucket_order(bank, axis).select(
        F.lit(axis).alias("axis"), "bucket", "n_qs"
    )
    return named("domain").unionByName(named("capability"))


@query(
    "A17_breakdown",
    with_relations(
        "fields tags",
        """SELECT parser, tag AS bucket,
             round(count(*) FILTER (WHERE status = 'correct') / count(*), 6) AS acc,
             count(*) AS n, count(DISTINCT f.doc) AS d
           FROM fields f JOIN tags t ON t.qid = f.qid GROUP BY parser, tag""",
    ),
)
def breakdown(spark, sf):
    return metrics.breakdown(
        outcomes(spark, sf), metrics.top_capability_buckets(rel.bank(spark, sf))
    ).withColumns(R6("acc"))


@query(
    "A18_row_coverage",
    with_relations(
        "cells",
        """SELECT parser, count(*) FILTER (WHERE NOT missing) AS n_seen, count(*) AS n_expected,
             count(*) FILTER (WHERE NOT missing) < count(*) AS incomplete
           FROM cells GROUP BY parser""",
    ),
)
def row_coverage(spark, sf):
    return metrics.row_coverage(rel.bank(spark, sf), rel.scored(spark, sf), SYSTEMS)


@query(
    "A19_parse_run_summary",
    with_relations(
        "",
        """SELECT parser, count(*) AS n_docs, count(*) FILTER (WHERE ok) AS n_ok,
             count(*) FILTER (WHERE NOT ok) AS n_fail, count(*) FILTER (WHERE cached) AS n_cached,
             round(coalesce(sum(cost_usd) FILTER (WHERE ok), 0) / count(*) FILTER (WHERE ok), 6)
               AS cost_per_doc,
             list_sort(list(latency_sec) FILTER (WHERE ok AND NOT cached AND latency_sec IS NOT NULL))
               [1 + count(latency_sec) FILTER (WHERE ok AND NOT cached) // 2] AS median_latency
           FROM meta GROUP BY parser""",
        meta=SQL_META,
    ),
)
def parse_run_summary(spark, sf):
    return metrics.parse_run_summary(parse_meta(spark, sf)).withColumns(R6("cost_per_doc"))


@query(
    "A20_bucket_overlap",
    with_relations(
        "asked",
        """SELECT count(*) FILTER (WHERE checkbox) AS checkbox, count(*) FILTER (WHERE blank)
             AS blank, count(*) FILTER (WHERE checkbox AND blank) AS overlap FROM asked""",
    ),
)
def bucket_overlap(spark, sf):
    return metrics.bucket_overlap(rel.bank(spark, sf))


@query(
    "A21_usage_summary",
    """WITH u AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
         FROM events)
       SELECT event_type, count(k) AS n, min(k) AS min, round(avg(k), 6) AS mean, max(k) AS max,
         CAST(floor(median(k)) AS BIGINT) AS p50,
         list_sort(list(k))[1 + least(count(k) - 1, count(k) * 95 // 100)] AS p95
       FROM u GROUP BY event_type""",
)
def usage_summary(spark, sf):
    usage = rel.table(spark, sf, "events").select(
        "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    return metrics.usage_summary(usage, "k", ["event_type"]).withColumns(R6("mean"))


def usage_calls(spark, sf):
    """Model calls from the event stream: domain, tokens, stop reason, whether the answer was read."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    user = F.col("user_id") % 4
    return rel.table(spark, sf, "events").select(
        F.when(user != 3, F.col("event_type")).alias("domain"), k.alias("k"), (k % 5 != 0).alias("parsed"),
        F.when(k % 7 == 0, "max_tokens").when(k % 11 == 0, None).otherwise("end_turn").alias("stop"),
    )


SQL_CALLS = """SELECT CASE WHEN user_id % 4 <> 3 THEN event_type ELSE '?' END AS domain, k, k % 5 <> 0 AS parsed,
    CASE WHEN k % 7 = 0 THEN 'max_tokens' WHEN k % 11 = 0 THEN '' ELSE 'end_turn' END AS stop
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(
    "A21_usage_by_domain",
    f"""SELECT domain, count(*) AS n, round(avg(k), 6) AS mean, min(k) AS min, max(k) AS max
        FROM ({SQL_CALLS}) GROUP BY domain""",
)
def usage_by_domain(spark, sf):
    return metrics.usage_by_domain(usage_calls(spark, sf), "k").withColumns(R6("mean"))


@query(
    "A21_stop_reasons",
    f"""SELECT domain, stop, count(*) AS n, count(*) FILTER (WHERE parsed) AS n_parsed
        FROM ({SQL_CALLS}) GROUP BY domain, stop""",
)
def stop_reasons(spark, sf):
    calls = usage_calls(spark, sf).withColumn("domain", F.coalesce("domain", F.lit("?")))
    return metrics.stop_reasons(calls, ["domain"])


@query(
    "A22_tag_prevalence",
    with_relations(
        "tags",
        """SELECT t.tag, count(*) AS n_qs, round(count(*) / (SELECT count(*) FROM asked), 6)
             AS bank_share, round(count(*) FILTER (WHERE a.checkbox)
               / (SELECT count(*) FROM asked WHERE checkbox), 6) AS bucket_share
           FROM tags t JOIN asked a ON a.qid = t.qid GROUP BY t.tag""",
    ),
)
def tag_prevalence(spark, sf):
    return metrics.tag_prevalence(rel.bank(spark, sf)).withColumns(
        R6("bank_share", "bucket_share")
    )


@query(
    "A23_attribute_crosstab",
    with_relations(
        "asked",
        """SELECT c_mktsegment, count(*) AS n_qs, count(DISTINCT d) AS n_docs,
             round(count(*) / sum(count(*)) OVER (), 6) AS share
           FROM asked JOIN customer ON c_custkey = d GROUP BY c_mktsegment""",
    ),
)
def attribute_crosstab(spark, sf):
    docs = rel.table(spark, sf, "customer").select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("doc"), "c_mktsegment"
    )
    return metrics.attribute_crosstab(
        rel.bank(spark, sf).select("qid", "doc"), docs, "c_mktsegment"
    ).withColumns(R6("share"))
