"""Queries over cost, quality gates and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeline.operators import cost, metrics, quality, reports
from gradeline.operators.cells import pending_cells
from gradeline.plans import relations as rel
from gradeline.plans.accuracy import R6, SQL_META, outcomes, parse_meta
from gradeline.plans.catalog import query
from gradeline.plans.relations import SYSTEMS, with_relations
from gradeline.sources.dimensions import REGISTRY_SCHEMA, price_catalog

SYSTEM_OF = lambda p: F.element_at(F.array(*[F.lit(s) for s in SYSTEMS]), p + 1)
SQL_SYSTEM = "CASE {0} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SYSTEMS)) + " END"

LONG_NOTE = "zero retention only by contract and only for the enterprise tier of the vendor"
# id, shape, transport, model, upstream_parser, precision, licence, terms, note, provenance,
# release_date, local, promptable, input_mode, input_per_mtok, output_per_mtok
ENTRIES = [
    ("alpha-8b@cloud", "vlm-chat", "openai-compat", "alpha-8b", None, "bf16", "apache-2.0", "ok",
     "", "acme", "2026-01-01", False, True, None, None, None),
    ("beta-xl@cloud", "vlm-chat", "gemini-native", "beta-xl", None, "provider-default", "closed",
     "conditional", LONG_NOTE, "google", "2026-06-01", False, True, None, 0.3, 2.5),
    ("alpha-ocr@cloud", "transcriber", "openai-compat", "alpha-8b", None, "fp8-vllm",
     "apache-2.0", "ok", "", " Google ", "2025-11-01", False, True, None, 0.1, 0.4),
    ("scanner-pro@vendor", "transcriber", "upstream-parser", None, "scanner_pro",
     "provider-default", "closed", "blocked", "no resale", "vendor", "2026-02-01", False, False,
     None, None, None),
    ("gamma@box", "vlm-chat", "openai-compat", "gamma", None, "q8-gguf", "mit", "ok", "", "lab",
     "2025-01-01", True, True, None, None, None),
]


def registry(spark):
    """The registry of the derived systems, in file order."""
    rows = [(*e, i) for i, e in enumerate(ENTRIES)]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA + ", ord int")


def entries(spark, rows):
    return reports.resolve_entries(rows.select("parser"), registry(spark))


SQL_ENTRIES = """SELECT * FROM (VALUES
  ('vlm__alpha-8b@cloud__0a1b2c3d4e5f', 'alpha-8b@cloud', NULL, NULL),
  ('vlm__beta-xl@cloud__0a1b2c3d4e5f', 'beta-xl@cloud', 0.3, 2.5),
  ('vlm__beta-xl@cloud__ffee00112233', 'beta-xl@cloud', 0.3, 2.5),
  ('alpha-ocr_cloud__0a1b2c3d4e5f', 'alpha-ocr@cloud', 0.1, 0.4),
  ('scanner_pro', 'scanner-pro@vendor', NULL, NULL),
  ('mystery_ocr', NULL, NULL, NULL)) v(parser, id, input_per_mtok, output_per_mtok)"""


def usage_rows(spark, sf):
    """Direct calls with usage as VARIANT, one per event."""
    e = rel.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    p = F.col("user_id") % 3
    text = F.concat(
        F.lit('{"prompt_tokens": '), (k * 10).cast("string"),
        F.lit(', "completion_tokens": '), F.when(k % 9 == 0, "null").otherwise(k.cast("string")),
        F.when((p == 0) & (k % 11 != 0),
               F.concat(F.lit(', "cost": '), (k / F.lit(1000.0)).cast("string"))).otherwise(""),
        F.when(p == 1, F.concat(
            F.lit(', "gemini_usage": {"thoughtsTokenCount": '), (k % 5).cast("string"),
            F.lit(', "totalTokenCount": '),
            (k * 10 + F.when(k % 9 == 0, 0).otherwise(k) + k % 5
             + F.when(k % 25 == 0, 3).otherwise(0)).cast("string"), F.lit("}"))).otherwise(""),
        F.when(p == 2, F.concat(
            F.lit(', "bedrock_usage": {"totalTokens": '),
            (k * 10 + F.when(k % 9 == 0, 0).otherwise(k)).cast("string"), F.lit("}")))
        .otherwise(""),
        F.lit("}"),
    )
    return e.select(
        F.col("event_id").alias("row_id"), "ts", SYSTEM_OF(p.cast("int")).alias("parser"),
        F.col("value").alias("latency_sec"), F.parse_json(text).alias("usage"),
        F.concat(F.lit("d"), (F.col("user_id") * 10 + k % 10).cast("string")).alias("doc"),
        "event_type", k.alias("k"),
    )


SQL_USAGE = f"""SELECT *, {SQL_SYSTEM.format('p')} AS parser,
    CASE WHEN k % 9 = 0 THEN 0 ELSE k END + CASE WHEN p = 1 THEN k % 5 ELSE 0 END AS out_tok,
    CASE WHEN p = 0 THEN CASE WHEN k % 11 <> 0 THEN k / 1000.0::DOUBLE END
      ELSE k * 10 / 1e6 * 0.3 + (CASE WHEN k % 9 = 0 THEN 0 ELSE k END
        + CASE WHEN p = 1 THEN k % 5 ELSE 0 END) / 1e6 * 2.5 END AS cost
  FROM (SELECT event_id AS row_id, ts, user_id, event_type, value, user_id % 3 AS p,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def priced_rows(spark, sf):
    rows = usage_rows(spark, sf)
    rates = entries(spark, rows).select("parser", "input_per_mtok", "output_per_mtok")
    return rows.join(rates, "parser", "left").withColumn(
        "cost",
        cost.row_cost(F.col("usage"), F.col("input_per_mtok"), F.col("output_per_mtok")),
    )


# -- cost --------------------------------------------------------------------------------------


def catalog(spark):
    return price_catalog(
        spark,
        {
            "src0": {"unit": "page", "usd": 0.01},
            "src1": {"unit": "page", "usd": 0.004},
            "src2": {"unit": "tokens", "input_usd_per_1k": 0.25, "output_usd_per_1k": 1.5},
            "src3": {"unit": "tokens", "input_usd_per_1k": 0.1, "output_usd_per_1k": 0.4},
        },
    )


SQL_DOC_COST = """SELECT doc_id, source, CASE WHEN doc_id % 7 <> 0 THEN n_chars // 1000 + 1 END
  AS pages, n_chars // 4 AS tin, doc_id % 50 AS tout FROM documents"""


@query(
    "C10_parse_cost",
    f"""WITH d AS ({SQL_DOC_COST}) SELECT doc_id, round(CASE source WHEN 'src0' THEN 0.01 * pages
          WHEN 'src1' THEN 0.004 * pages END, 6) AS cost FROM d""",
)
def parse_cost(spark, sf):
    d = rel.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("provider"),
        F.when(F.col("doc_id") % 7 != 0, F.floor(F.col("n_chars") / 1000) + 1).alias("pages"),
    )
    return cost.parse_cost(d, catalog(spark)).select("doc_id", F.round("cost", 6).alias("cost"))


@query(
    "C11_agent_cost",
    f"""WITH d AS ({SQL_DOC_COST}) SELECT doc_id, round(CASE source
          WHEN 'src2' THEN 0.25 * tin / 1000 + 1.5 * tout / 1000
          WHEN 'src3' THEN 0.1 * tin / 1000 + 0.4 * tout / 1000 END, 6) AS cost FROM d""",
)
def agent_cost(spark, sf):
    d = rel.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("provider"),
        F.floor(F.col("n_chars") / 4).alias("input_tokens"),
        (F.col("doc_id") % 50).alias("output_tokens"),
    )
    return cost.agent_cost(d, catalog(spark)).select("doc_id", F.round("cost", 6).alias("cost"))


@query(
    "C12_billable_output",
    f"WITH u AS ({SQL_USAGE}) SELECT row_id, CAST(out_tok AS BIGINT) AS billable FROM u",
)
def billable_output(spark, sf):
    return usage_rows(spark, sf).select(
        "row_id", cost.billable_output_tokens(F.col("usage")).alias("billable")
    )


@query(
    "C13_unaccounted_tokens",
    f"""WITH u AS ({SQL_USAGE}) SELECT row_id, parser, CAST(3 AS BIGINT) AS unaccounted FROM u
        WHERE p = 1 AND k % 25 = 0""",
)
def unaccounted(spark, sf):
    return usage_rows(spark, sf).select(
        "row_id", "parser", cost.unaccounted_tokens(F.col("usage")).alias("unaccounted")
    ).where("unaccounted <> 0")


@query(
    "C14_direct_cost_latency",
    f"""WITH u AS ({SQL_USAGE}) SELECT parser, count(*) AS n, round(median(value), 6)
          AS median_latency, round(sum(cost), 4) AS cost_usd FROM u GROUP BY parser""",
)
def direct_cost_latency(spark, sf):
    rows = usage_rows(spark, sf)
    return cost.direct_cost_latency(rows, entries(spark, rows)).withColumns(
        {"cost_usd": F.round("cost_usd", 4), **R6("median_latency")}
    )


@query(
    "C15_transcriber_cost_latency",
    with_relations(
        "",
        """SELECT parser, round(median(latency_sec), 6) AS median_latency,
             CASE p WHEN 3 THEN 'unrecorded' WHEN 4 THEN 'unpriced' ELSE 'recorded' END
               AS cost_status,
             CASE WHEN p = 5 THEN round(sum(cost_usd), 4) END AS cost_usd
           FROM meta WHERE ok AND p >= 3 GROUP BY parser, p""",
        meta=SQL_META,
    ),
)
def transcriber_cost_latency(spark, sf):
    meta = parse_meta(spark, sf).where(~F.col("parser").startswith("vlm__"))
    return cost.transcriber_cost_latency(meta, entries(spark, meta)).withColumns(
        {"cost_usd": F.round("cost_usd", 4), **R6("median_latency")}
    )


@query(
    "C16_spend_ledger",
    f"""WITH u AS ({SQL_USAGE}), l AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY parser
          ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING), 0) AS running FROM u),
        s AS (SELECT *, cost IS NULL OR running > 0.5 AS stop FROM l)
        SELECT parser, round(sum(cost), 4) AS total,
          count(*) FILTER (WHERE cost IS NULL) AS n_unknown,
          arg_min(row_id, (ts, row_id)) FILTER (WHERE stop) AS stop_row,
          round(arg_min(running, (ts, row_id)) FILTER (WHERE stop), 4) AS stop_spend,
          CASE WHEN count(*) FILTER (WHERE stop) = 0 THEN 'within cap'
            WHEN arg_min(cost IS NULL, (ts, row_id)) FILTER (WHERE stop) THEN 'unknown cost'
            ELSE 'cap' END AS reason
        FROM s GROUP BY parser""",
)
def spend_ledger(spark, sf):
    return cost.spend_ledger(priced_rows(spark, sf), ["parser"], 0.5).withColumns(
        {"total": F.round("total", 4), "stop_spend": F.round("stop_spend", 4)}
    )


@query(
    "C17_dry_run_estimate",
    with_relations(
        "cells",
        """SELECT c.parser, count(*) AS cells, round(count(*) * (2000 / 1e6 * input_per_mtok
             + 120 / 1e6 * output_per_mtok), 2) AS est_usd, input_per_mtok IS NOT NULL AS priced
           FROM cells c JOIN e ON e.parser = c.parser WHERE missing
           GROUP BY c.parser, input_per_mtok, output_per_mtok""",
        e=SQL_ENTRIES,
    ),
)
def dry_run_estimate(spark, sf):
    todo = pending_cells(rel.bank(spark, sf), rel.scored(spark, sf), SYSTEMS)
    return cost.dry_run_estimate(todo, entries(spark, todo))


@query(
    "C18_transcriber_row_cost",
    f"""WITH m AS ({SQL_META}), e AS ({SQL_ENTRIES})
        SELECT m.parser, m.doc, round(CASE WHEN m.c % 5 <> 0 THEN
          m.c * 100 / 1e6 * input_per_mtok + m.md_length / 1e6 * output_per_mtok END, 8) AS cost
        FROM m JOIN e ON e.parser = m.parser WHERE p >= 3""",
)
def transcriber_row_cost(spark, sf):
    meta = parse_meta(spark, sf).where(~F.col("parser").startswith("vlm__"))
    c = F.substring("doc", 2, 20).cast("bigint")
    rows = meta.withColumns(
        {
            "input_tokens": F.when(c % 5 != 0, c * 100),
            "output_tokens": F.when(c % 5 != 0, F.col("md_length")),
        }
    )
    # Document 0 used no tokens at all, which is as unknown as a missing record.
    return cost.transcriber_row_cost(rows, entries(spark, meta)).select(
        "parser", "doc", F.round("cost", 8).alias("cost")
    )


@query(
    "C19_decision_table",
    with_relations(
        "fields",
        f"""SELECT a.parser, correct, round(correct / n, 6) AS accuracy,
             round((n - correct) / n * 1000, 6) AS errors_per_1000,
             round(cost_usd / pages * 10000, 4) AS cost_per_10k_pages,
             correct - majority AS errors_avoided,
             round(CASE WHEN correct > majority THEN cost_usd / (correct - majority) END, 6)
               AS cost_per_error_avoided
           FROM acc a LEFT JOIN (SELECT parser, sum(cost) AS cost_usd FROM u GROUP BY parser) c
             ON c.parser = a.parser,
           (SELECT greatest(count(*) FILTER (WHERE gold_true), count(*) FILTER (WHERE NOT gold_true))
              AS majority FROM gold WHERE checkbox AND kind = 'bool') m,
           (SELECT count(*) AS pages FROM customer) d""",
        u=SQL_USAGE,
        acc="""SELECT parser, count(*) AS n, count(*) FILTER (WHERE status = 'correct') AS correct
          FROM fields WHERE checkbox AND kind = 'bool' GROUP BY parser""",
    ),
)
def decision_table(spark, sf):
    rows = metrics.boolean_gold(outcomes(spark, sf))
    acc = rows.groupBy("parser").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "correct").alias("correct")
    )
    usage = usage_rows(spark, sf)
    costs = cost.direct_cost_latency(usage, entries(spark, usage))
    balance = metrics.class_balance(metrics.boolean_golds(rel.bank(spark, sf)))
    right = balance.select(F.greatest("n_true", "n_false")).scalar()
    pages = rel.table(spark, sf, "customer").select(F.count("*")).scalar()
    return cost.decision_table(acc, costs, right, pages).withColumns(
        {"cost_per_10k_pages": F.round("cost_per_10k_pages", 4),
         **R6("accuracy", "errors_per_1000", "cost_per_error_avoided")}
    )


@query(
    "C20_deduplicated_input",
    f"""WITH u AS ({SQL_USAGE}), d AS (SELECT parser, user_id * 10 + k % 10 AS doc,
          sum(k * 10) AS a, max(k * 10) AS o FROM u GROUP BY ALL)
        SELECT parser, CAST(sum(a) AS BIGINT) AS tokens_per_question,
          CAST(sum(o) AS BIGINT) AS tokens_per_page, round(1 - sum(o) / sum(a), 6) AS saved_share
        FROM d GROUP BY parser""",
)
def deduplicated_input(spark, sf):
    rows = usage_rows(spark, sf).withColumn("image_tokens", F.col("k") * 10)
    return cost.deduplicated_input(rows).withColumns(R6("saved_share"))


@query(
    "C21_spend_rollup",
    f"""WITH u AS ({SQL_USAGE}) SELECT CAST(date_trunc('day', ts) AS DATE) AS session, parser,
          CAST(grouping_id(CAST(date_trunc('day', ts) AS DATE), parser) AS INTEGER) AS level,
          round(sum(cost), 4) AS cost, count(*) FILTER (WHERE cost IS NULL) AS n_unknown,
          count(*) AS n
        FROM u GROUP BY ROLLUP (CAST(date_trunc('day', ts) AS DATE), parser)""",
)
def spend_rollup(spark, sf):
    rows = priced_rows(spark, sf).withColumn("session", F.to_date("ts"))
    return cost.spend_rollup(rows).withColumn("cost", F.round("cost", 4))


# -- quality gates -----------------------------------------------------------------------------

SQL_COUNTS = """SELECT 'bank_items' AS name, count(*) AS measured FROM asked
  UNION ALL SELECT 'bank_fields', count(*) FROM gold
  UNION ALL SELECT 'bank_nulls', count(*) FROM gold WHERE kind = 'null'
  UNION ALL SELECT 'checkbox_questions', count(*) FROM asked WHERE checkbox
  UNION ALL SELECT 'checkbox_docs', count(DISTINCT doc) FROM asked WHERE checkbox
  UNION ALL SELECT 'checkbox_fields', count(*) FROM gold WHERE checkbox
  UNION ALL SELECT 'checkbox_booleans', count(*) FROM gold WHERE checkbox AND kind = 'bool'
  UNION ALL SELECT 'checkbox_true', count(*) FROM gold WHERE checkbox AND gold_true
  UNION ALL SELECT 'checkbox_false', count(*) FROM gold WHERE checkbox AND NOT gold_true
  UNION ALL SELECT 'blank_questions', count(*) FROM asked WHERE blank
  UNION ALL SELECT 'blank_nulls', count(*) FROM gold WHERE blank AND kind = 'null'
  UNION ALL SELECT 'bucket_overlap', count(*) FROM asked WHERE checkbox AND blank"""
# The counts of the published question bank.
PINS = {
    "bank_items": 1356, "bank_fields": 3742, "bank_nulls": 188, "checkbox_questions": 429,
    "checkbox_docs": 263, "checkbox_fields": 1117, "checkbox_booleans": 258,
    "checkbox_true": 165, "checkbox_false": 93, "blank_questions": 122, "blank_nulls": 34,
    "bucket_overlap": 40,
}


@query(
    "G01_bank_mismatches",
    with_relations(
        "gold asked",
        "SELECT name, measured, expected FROM counts JOIN pins USING (name) "
        "WHERE measured <> expected",
        counts=SQL_COUNTS,
        pins="SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in PINS.items())
        + ") v(name, expected)",
    ),
)
def bank_mismatches(spark, sf):
    pins = spark.createDataFrame(list(PINS.items()), "name string, expected bigint")
    return quality.bank_mismatches(rel.bank(spark, sf), pins)


@query(
    "G02_missing_documents",
    with_relations(
        "asked", "SELECT DISTINCT doc FROM asked WHERE d NOT IN (SELECT doc_id FROM documents "
        "WHERE source <> 'src2')"
    ),
)
def missing_documents(spark, sf):
    # The copy of one source was never finished.
    corpus = rel.table(spark, sf, "documents").where("source <> 'src2'").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc")
    )
    return quality.missing_documents(rel.bank(spark, sf), corpus)


@query(
    "G03_serving_identity",
    """SELECT user_id AS parser, count(DISTINCT prov) AS n_providers,
         string_agg(DISTINCT prov, ',' ORDER BY prov) AS providers
       FROM (SELECT user_id, CASE event_type WHEN 'view' THEN '(empty)' ELSE event_type END AS prov
             FROM events WHERE event_type <> 'error') GROUP BY user_id
       HAVING count(DISTINCT prov) > 1""",
)
def serving_identity(spark, sf):
    t = F.col("event_type")
    rows = rel.table(spark, sf, "events").select(
        F.col("user_id").alias("parser"),
        F.when(t == "error", "api_error").otherwise("none").alias("error_class"),
        F.when(t == "view", "").otherwise(t).alias("resolved_provider"),
    )
    return quality.serving_identity(rows)


@query(
    "G04_stale_windows",
    """SELECT parser, count(*) AS n, min(ts) AS first, max(ts) AS last
       FROM (SELECT user_id AS parser, ts, event_type, value FROM events) GROUP BY parser
       HAVING count(*) >= 2 AND max(ts) - min(ts) > INTERVAL 7 DAY
         AND count(*) FILTER (WHERE value > 400) = 0""",
)
def stale_windows(spark, sf):
    # Rows above a value carry a stamp that cannot be read.
    stamp = F.when(F.col("value") > 400, "not a time").otherwise(F.col("ts").cast("string"))
    rows = rel.table(spark, sf, "events").select(
        F.col("user_id").alias("parser"), stamp.alias("retrieved_at")
    )
    return quality.stale_windows(rows)


@query(
    "G05_incomplete_items",
    """SELECT 'k' || doc_id AS qid, source = 'src3' AS no_document, length(trim(text)) = 0
         OR lang = 'zh' AS no_gold FROM documents WHERE source = 'src3' OR lang = 'zh'
         OR length(trim(text)) = 0""",
)
def incomplete_items(spark, sf):
    empty = (F.length(F.trim("text")) == 0) | (F.col("lang") == "zh")
    bank = rel.table(spark, sf, "documents").select(
        F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("qid"),
        F.when(F.col("source") != "src3", F.col("source")).alias("doc"),
        F.when(empty, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("fields"),
    )
    return quality.incomplete_items(bank)


@query(
    "G06_duplicate_ids",
    """SELECT id, count(*) AS n FROM (SELECT doc_id AS id FROM documents
         UNION ALL SELECT page_id FROM pages UNION ALL SELECT item_id FROM benchmark)
       GROUP BY id HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf):
    ids = lambda t, c: rel.table(spark, sf, t).select(F.col(c).alias("id"))
    return quality.duplicate_ids(
        ids("documents", "doc_id"), ids("pages", "page_id"), ids("benchmark", "item_id")
    )


@query(
    "G07_near_empty",
    f"WITH m AS ({SQL_META}) SELECT parser, doc FROM m WHERE ok AND md_length <= 16 * "
    "greatest(1, page_count)",
)
def near_empty(spark, sf):
    return quality.near_empty_transcripts(parse_meta(spark, sf)).select("parser", "doc")


@query(
    "G08_content_drift",
    """SELECT 'leg' || (doc_id % 3) AS parser, 'd' || doc_id AS doc,
         CASE WHEN source = 'src1' THEN 'UNAVAILABLE' ELSE 'STALE' END AS state
       FROM documents WHERE source = 'src1' OR lang = 'de'""",
)
def content_drift(spark, sf):
    # One source lost its files; German documents were replaced since they were answered.
    d = rel.table(spark, sf, "documents")
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = d.select(
        F.concat(F.lit("leg"), (F.col("doc_id") % 3).cast("string")).alias("parser"),
        doc.alias("doc"), F.sha2("text", 256).alias("image_sha"),
    )
    files = d.where("source <> 'src1'").select(
        doc.alias("doc"), F.encode(changed, "UTF-8").alias("content")
    )
    return quality.content_drift(rows, files)


@query(
    "G12_bank_subsets",
    with_relations(
        "asked gold",
        """SELECT qid, key, kind, gold_true FROM gold WHERE (checkbox AND kind = 'bool')
             OR kind = 'null'""",
    ),
)
def bank_subsets(spark, sf):
    flat = rel.bank(spark, sf).select("qid", "capabilities", F.inline("fields")).withColumnRenamed(
        "gold_kind", "kind"
    )
    box = metrics.has_any_tag(F.col("capabilities"), metrics.CHECKBOX_TAGS)
    keep = (box & (F.col("kind") == "bool")) | (F.col("kind") == "null")
    return flat.where(keep).select("qid", "key", "kind", "gold_true")


@query(
    "G13_oversized_payloads",
    with_relations(
        "rows gold",
        """SELECT r.parser, count(*) AS n_cells, count(*) FILTER (WHERE b.q IS NOT NULL)
             AS n_metric_cells, count(DISTINCT r.doc) AS n_docs
           FROM rows r LEFT JOIN (SELECT DISTINCT q FROM gold WHERE checkbox AND kind = 'bool') b
             ON b.q = r.q
           WHERE r.p < 3 AND ((r.d * 3571337 % 5000000 + 2) // 3) * 4 > 5242880 GROUP BY r.parser""",
    ),
)
def oversized(spark, sf):
    d = F.substring("doc", 2, 20).cast("bigint")
    rows = rel.scored(spark, sf).where(F.col("parser").startswith("vlm__")).select(
        "qid", "parser", "doc", (d * 3571337 % 5000000).alias("image_bytes")
    )
    return quality.oversized_payloads(rows, rel.bank(spark, sf), 5242880)


# -- report tables -----------------------------------------------------------------------------


@query(
    "T14_resolve_entries",
    with_relations(
        "rows", "SELECT DISTINCT r.parser, e.id FROM rows r JOIN e ON e.parser = r.parser",
        e=SQL_ENTRIES,
    ),
)
def resolve_entries(spark, sf):
    return entries(spark, rel.scored(spark, sf)).select("parser", "id")


@query(
    "J08_calibration_pairs",
    with_relations(
        "rows",
        f"""SELECT a.parser AS direct, b.parser AS transcriber, 'alpha-8b' AS model
           FROM (SELECT DISTINCT parser FROM rows WHERE p = 0) a,
                (SELECT DISTINCT parser FROM rows WHERE p = 3) b""",
    ),
)
def calibration(spark, sf):
    return reports.calibration_pairs(entries(spark, rel.scored(spark, sf)))


@query(
    "R02_section_a",
    with_relations(
        "fields rows",
        """SELECT f.parser, e.id || CASE WHEN f.parser LIKE '%beta%' THEN ' [cond ' ||
             split_part(f.parser, '__', 3) || ']' ELSE '' END AS label,
             round(avg((status = 'correct')::INT), 6) AS general_field_acc,
             any_value(s.n) AS n_rows
           FROM fields f JOIN e ON e.parser = f.parser
           JOIN (SELECT parser, count(*) AS n FROM rows GROUP BY parser) s ON s.parser = f.parser
           WHERE f.p < 3 GROUP BY f.parser, e.id""",
        e=SQL_ENTRIES,
    ),
)
def section_a(spark, sf):
    return _section(spark, sf, "direct").drop("same_family", "registered")


@query(
    "R03_section_b",
    with_relations(
        "fields rows",
        """SELECT f.parser, coalesce(e.id, f.parser || ' (unregistered)') AS label,
             round(avg((status = 'correct')::INT), 6) AS general_field_acc,
             any_value(s.n) AS n_rows, f.p = 3 AS same_family, f.p < 5 AS registered
           FROM fields f JOIN e ON e.parser = f.parser
           JOIN (SELECT parser, count(*) AS n FROM rows GROUP BY parser) s ON s.parser = f.parser
           WHERE f.p >= 3 GROUP BY f.parser, e.id, f.p""",
        e=SQL_ENTRIES,
    ),
)
def section_b(spark, sf):
    return _section(spark, sf, "transcriber")


def _section(spark, sf, section):
    stored = rel.scored(spark, sf)
    acc = metrics.general_accuracy(outcomes(spark, sf))
    n = stored.groupBy("parser").agg(F.count("*").alias("n_rows"))
    rows = acc.join(n, "parser").withColumn("no_image", F.lit(False))
    return reports.leaderboard(rows, entries(spark, stored), section).select(
        "parser", "label", F.round("general_field_acc", 6).alias("general_field_acc"), "n_rows",
        "same_family", "registered",
    )


@query(
    "R04_labels",
    with_relations(
        "rows",
        """SELECT DISTINCT parser, CASE p WHEN 0 THEN 'alpha-8b@cloud'
             WHEN 1 THEN 'beta-xl@cloud [cond 0a1b2c3d4e5f]'
             WHEN 2 THEN 'beta-xl@cloud [cond ffee00112233]' WHEN 3 THEN 'alpha-ocr@cloud'
             WHEN 4 THEN 'scanner-pro@vendor' ELSE 'mystery_ocr (unregistered)' END AS label
           FROM rows""",
    ),
)
def labels(spark, sf):
    return reports.labels(entries(spark, rel.scored(spark, sf))).select("parser", "label")


U = "'unknown (unregistered)'"


@query(
    "R05_stamps",
    with_relations(
        "rows",
        f"""SELECT DISTINCT parser,
             CASE p WHEN 0 THEN 'bf16' WHEN 3 THEN 'fp8-vllm' WHEN 5 THEN {U}
               ELSE 'unknown (not asserted)' END AS precision,
             CASE WHEN p IN (0, 3) THEN 'apache-2.0' WHEN p = 5 THEN {U} ELSE 'closed' END AS licence,
             CASE WHEN p IN (0, 3) THEN 'ok' WHEN p IN (1, 2) THEN 'conditional — '
               || substr('{LONG_NOTE}', 1, 60) WHEN p = 4 THEN 'blocked — no resale' ELSE {U} END
               AS tos,
             CASE WHEN p IN (1, 2) THEN 'yes' WHEN p = 5 THEN {U} ELSE 'no' END AS contaminated,
             CASE p WHEN 4 THEN 'not-promptable' WHEN 5 THEN {U} ELSE 'promptable' END AS contract
           FROM rows""",
    ),
)
def stamps(spark, sf):
    return reports.stamps(entries(spark, rel.scored(spark, sf)))


@query(
    "R06_mixed_precision",
    with_relations(
        "rows",
        """SELECT section, string_agg(DISTINCT prec, ', ' ORDER BY prec) AS precisions,
             'mixed precision' AS note FROM (SELECT CASE WHEN p < 3 THEN 'direct'
               ELSE 'transcriber' END AS section, CASE p WHEN 0 THEN 'bf16' WHEN 3 THEN 'fp8-vllm'
               ELSE 'unknown (not asserted)' END AS prec FROM rows WHERE p < 5) GROUP BY section""",
    ),
)
def mixed_precision(spark, sf):
    from gradeline.operators.cells import section_of

    e = entries(spark, rel.scored(spark, sf)).withColumn(
        "section", section_of(F.col("parser"), F.lit(False))
    )
    return reports.mixed_precision(e, ["section"])


@query(
    "R07_input_label",
    with_relations(
        "rows",
        """SELECT DISTINCT parser, CASE WHEN p IN (0, 3) THEN 'raster-png'
             WHEN p = 5 THEN 'unknown (unregistered)' ELSE 'pdf-direct' END AS input FROM rows""",
    ),
)
def input_label(spark, sf):
    return reports.input_label(entries(spark, rel.scored(spark, sf)))


@query(
    "R08_sorted_table",
    """SELECT doc_id, quality, rank() OVER (ORDER BY quality DESC NULLS FIRST) AS place
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def sorted_table(spark, sf):
    # The order itself is a column too: the place of each value, from one count per value.
    docs = rel.table(spark, sf, "documents").select("doc_id")
    rows = docs.join(rel.table(spark, sf, "labels"), "doc_id", "left")
    before = Window.orderBy(F.desc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    places = rows.groupBy(F.col("quality").alias("v")).agg(F.count("*").alias("n")).select(
        "v", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("place")
    )
    placed = rows.join(places, F.col("quality").eqNullSafe(F.col("v")))
    return reports.sorted_table(placed, "quality").select("doc_id", "quality", "place")


@query(
    "R09_pareto",
    """WITH b AS (SELECT l_extendedprice AS x, max(l_quantity) AS best FROM lineitem GROUP BY 1),
         e AS (SELECT *, max(best) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS earlier FROM b)
       SELECT l_orderkey, l_linenumber, x, l_quantity AS y FROM lineitem
       JOIN e ON x = l_extendedprice WHERE l_quantity = best AND (earlier IS NULL OR best > earlier)""",
)
def pareto(spark, sf):
    points = rel.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"),
        F.col("l_quantity").alias("y"),
    )
    return reports.pareto(points).where("on_frontier").drop("on_frontier")


@query(
    "R10_reproduction_gate",
    with_relations(
        "rows",
        """SELECT parser, round(sum(n_matched) / sum(n_fields), 6) AS field_share,
             round(count(*) FILTER (WHERE match) / count(*), 6) AS question_share,
             count(*) AS n_ok FROM rows WHERE NOT failed AND p >= 3 GROUP BY parser""",
    ),
)
def reproduction_gate(spark, sf):
    return reports.reproduction_gate(rel.scored(spark, sf)).withColumns(
        R6("field_share", "question_share")
    )


@query(
    "R11_against_targets",
    with_relations(
        "rows",
        """SELECT parser, round(f - tf, 6) AS field_diff, round(q - tq, 6) AS question_diff,
             abs(f - tf) <= 2.5 AND abs(q - tq) <= 2.5 AS within
           FROM (SELECT parser, 100 * sum(n_matched) / sum(n_fields) AS f,
                   100 * count(*) FILTER (WHERE match) / count(*) AS q
                 FROM rows WHERE NOT failed AND p >= 3 GROUP BY parser)
           JOIN (VALUES ('scanner_pro', 89.3, 82.2), ('mystery_ocr', 93.0, 80.0)) t(parser, tf, tq)
             USING (parser)""",
    ),
)
def against_targets(spark, sf):
    targets = spark.createDataFrame(
        [("scanner_pro", 89.3, 82.2), ("mystery_ocr", 93.0, 80.0)],
        "parser string, target_field_pct double, target_question_pct double",
    )
    return reports.against_targets(
        reports.reproduction_gate(rel.scored(spark, sf)), targets
    ).withColumns(R6("field_diff", "question_diff"))


@query(
    "S10_catalog_stamp",
    f"""WITH d AS (SELECT source AS provider, n_chars // 1000 + 1 AS pages FROM documents),
         rates AS (SELECT * FROM (VALUES ('src0', 'page', 'usd', '0.01', NULL, NULL), ('src1', 'page', 'usd', '0.004', NULL, NULL),
           ('src2', 'tokens', 'input_usd_per_1k', '0.25', 'output_usd_per_1k', '1.5'),
           ('src3', 'tokens', 'input_usd_per_1k', '0.1', 'output_usd_per_1k', '0.4')) v(provider, unit, k1, v1, k2, v2)),
         texts AS (SELECT '{{"provider":"' || provider || '","unit":"' || unit || '","' || k1 || '":' || v1
           || coalesce(',"' || k2 || '":' || v2, '') || '}}' AS t FROM rates)
       SELECT provider, round(sum(CASE provider WHEN 'src0' THEN 0.01 * pages WHEN 'src1' THEN 0.004 * pages END), 4) AS cost,
         (SELECT left(sha256(string_agg(t, chr(10) ORDER BY t)), 12) FROM texts) AS catalog_sha
       FROM d GROUP BY provider""",
)
def catalog_costs(spark, sf):
    from gradeline.sources.dimensions import catalog_stamp

    docs = rel.table(spark, sf, "documents").select(
        F.col("source").alias("provider"), (F.floor(F.col("n_chars") / 1000) + 1).alias("pages")
    )
    priced = cost.parse_cost(docs, catalog(spark)).groupBy("provider").agg(
        F.round(F.sum("cost"), 4).alias("cost")
    )
    return priced.withColumn("catalog_sha", catalog_stamp(catalog(spark)).scalar())
