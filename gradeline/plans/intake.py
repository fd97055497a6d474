"""Queries over sources and sinks, and the streaming jobs run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.operators import layout as lay
from gradeline.operators import metrics, reports
from gradeline.operators import payloads as pay
from gradeline.plans import relations as rel
from gradeline.plans.accuracy import R6, SQL_BUCKET_MAP, SQL_BUCKETS, SQL_ERROR_CLASS, buckets
from gradeline.plans.catalog import ORACLES, query
from gradeline.plans.page_layout import (
    CELL_SQL, CLASS_TEXT, SIDES, pairs, predictions, prf_sql, shown_classes, truth, with_lines,
)
from gradeline.plans.relations import SYSTEMS, with_relations
from gradeline.plans.statistics import sql_resample
from gradeline.session import work_folder
from gradeline.sources import files as src
from gradeline.sources import rewrite
from gradeline.streaming import live

# -- sources -----------------------------------------------------------------------------------


def bank_texts(spark, sf):
    """One envelope per question, as bank files hold them."""
    b = rel.bank(spark, sf, with_gold=True)
    gold = F.to_json(F.map_from_entries(
        F.transform("fields", lambda f: F.struct(f["key"], f["gold"]))
    ))
    strings = F.array_join(
        F.transform(
            F.filter("fields", lambda f: f["is_string"]),
            lambda f: F.concat(F.lit('\\"'), f["key"], F.lit('\\": <string>')),
        ), ", ",
    )
    item = F.concat(
        F.lit('{"question_id": "'), "qid", F.lit('", "source_file": "'), "doc",
        F.lit('", "domain": "'), "domain", F.lit('", "template": "{'), strings,
        F.lit('}", "capabilities": '), F.to_json("capabilities"), F.lit(', "gold_dict": '), gold,
        F.lit("}"),
    )
    text = F.when(F.col("q") % 2 == 0, F.concat(F.lit('{"items": ['), item, F.lit("]}"))).otherwise(
        F.concat(F.lit("["), item, F.lit("]"))
    )
    return b.select(text.alias("value"))


@query(
    "S01_load_bank",
    with_relations(
        "gold",
        """SELECT qid, doc, domain, key, kind AS gold_kind, gold_true, kind = 'str' AS is_string
           FROM gold""",
    ),
)
def load_bank(spark, sf):
    return src.parse_bank(bank_texts(spark, sf)).select(
        "qid", "doc", "domain", F.inline("fields")
    ).drop("gold")


def null_error():
    """Rows whose error key is there and holds null: still an error."""
    return F.col("error").isNull() & (F.col("q") % 37 == 5)


def answer_texts(spark, sf, *, null_errors=True):
    """Stored rows as JSON documents; some are torn or lack their keys, and some hold a null error."""
    a = rel.stored(spark, sf)
    null = null_error() if null_errors else F.lit(False)
    text = lambda name, c: F.when(
        c.isNotNull(), F.concat(F.lit(f', "{name}": '), c)
    ).otherwise("")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    row = F.concat(
        F.lit('{"qid": "'), "qid", F.lit('"'),
        F.when(F.col("q") % 31 != 0, text("parser", quote(F.col("parser")))).otherwise(""),
        text("domain", quote(F.col("domain"))),
        F.when(null, F.lit(', "error": null')).otherwise(text("error", quote(F.col("error")))),
        F.when(F.col("has_answer"), text("answer", F.to_json("answer"))).otherwise(""),
    )
    return a.select(
        F.when(F.col("q") % 29 == 0, row).otherwise(F.concat(row, F.lit("}"))).alias("value")
    )


SQL_READABLE = "SELECT * FROM rows WHERE q % 31 <> 0 AND q % 29 <> 0"


@query(
    "S02_load_answers",
    with_relations(
        "rows",
        """SELECT qid, parser, has_answer, has_answer AND NOT junk AS is_object,
             CASE WHEN error IS NULL AND q % 37 = 5 THEN '' ELSE error END AS error FROM readable""",
        readable=SQL_READABLE,
    ),
)
def load_answers(spark, sf):
    return src.parse_answers(answer_texts(spark, sf)).select(
        "qid", "parser", "has_answer", "is_object", "error"
    )


@query(
    "S03_shown_answers",
    with_relations(
        "rows",
        """SELECT parser, count(*) AS n FROM readable WHERE has_answer AND error IS NULL
             GROUP BY parser""",
        readable=SQL_READABLE,
    ),
)
def shown_answers(spark, sf):
    return src.shown_answers(src.parse_answers(answer_texts(spark, sf, null_errors=False))).groupBy("parser").agg(
        F.count("*").alias("n")
    )


@query(
    "S04_snapshot",
    with_relations(
        "rows",
        """SELECT parser, count(*) AS n, count(*) FILTER (WHERE has_answer) AS n_answers
           FROM readable GROUP BY parser""",
        readable=SQL_READABLE,
    ),
)
def snapshot(spark, sf):
    folder = work_folder(spark, "snapshot")
    src.write_snapshot(src.parse_answers(answer_texts(spark, sf)), folder)
    return src.read_snapshot(spark, folder).groupBy("parser").agg(
        F.count("*").alias("n"), F.count_if("has_answer").alias("n_answers")
    )


@query(
    "S05_transcripts",
    """SELECT source AS parser, 'd' || doc_id AS doc, length(text) AS n FROM documents
       WHERE lang <> 'fr'""",
)
def transcripts(spark, sf):
    d = rel.table(spark, sf, "documents")
    base = F.concat(F.lit("run/parses/"), "source", F.lit("/d"), F.col("doc_id").cast("string"))
    texts = d.select(F.concat(base, F.lit(".md")).alias("path"), F.col("text").alias("value"))
    # The French documents failed to parse.
    record = F.concat(F.lit('{"ok": '), (F.col("lang") != "fr").cast("string"), F.lit("}"))
    meta = d.select(F.concat(base, F.lit(".json")).alias("path"), record.alias("value"))
    side = d.select(F.concat(F.lit("run/parses/"), "source", F.lit("/condition.json")).alias("path"),
                    F.lit("{}").alias("value")).distinct()
    files = texts.unionByName(meta).unionByName(side)
    fine = src.fine_transcripts(src.parse_transcripts(files), src.parse_metadata(files))
    return fine.select("parser", "doc", F.length("text").cast("bigint").alias("n"))


@query(
    "S06_docs_of_first_items",
    "SELECT o_custkey AS doc, min(o_orderkey) AS first_ord FROM orders WHERE o_orderkey < 500 "
    "GROUP BY o_custkey",
)
def docs_of_first_items(spark, sf):
    bank = rel.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("doc")
    )
    return src.docs_of_first_items(bank, 500)


@query(
    "S07_layout_samples",
    """SELECT p.page_id, split_part(url, '/', 4) AS domain, d.text IS NOT NULL AS loaded
       FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id AND d.lang = 'en'
       WHERE split_part(url, '/', 4) IN ('en', 'fr')""",
)
def layout_samples(spark, sf):
    manifest = rel.table(spark, sf, "pages").select(
        F.col("page_id").alias("ord"), "page_id",
        F.split_part("url", F.lit("/"), F.lit(4)).alias("domain"),
    )
    notes = rel.table(spark, sf, "documents").where("lang = 'en'").select(
        F.col("doc_id").alias("page_id"), F.col("text").alias("annotation")
    )
    return src.layout_samples(manifest, notes, domains=["en", "fr"], absent="keep").select(
        "page_id", "domain", F.col("annotation").isNotNull().alias("loaded")
    )


SQL_MANIFEST = """SELECT page_id, split_part(url, '/', 4) AS domain,
    row_number() OVER (ORDER BY page_id * 7919 % 10007, page_id) - 1 AS ord FROM pages"""


def written_manifest(spark, sf):
    """The pages as a CSV manifest of several files, in an order of its own, read back."""
    folder = work_folder(spark, "manifest")
    pages = rel.table(spark, sf, "pages").orderBy(F.col("page_id") * 7919 % 10007, "page_id")
    pages.select(
        F.col("page_id").alias("pageId"), F.split_part("url", F.lit("/"), F.lit(4)).alias("domain"),
        F.col("url").alias("sourceUrl"), F.lit(None).cast("string").alias("originalImageUrl"),
    ).write.csv(folder, header=True)
    return src.read_manifest(spark, folder).withColumn("page_id", F.col("page_id").cast("bigint"))


def english_notes(spark, sf):
    return rel.table(spark, sf, "documents").where("lang = 'en'").select(
        F.col("doc_id").alias("page_id"), F.col("text").alias("annotation")
    )


@query(
    "S07_limit_before_load",
    f"""SELECT m.ord, m.page_id, m.domain, d.doc_id IS NOT NULL AS loaded
        FROM (SELECT * FROM ({SQL_MANIFEST}) WHERE domain IN ('en', 'fr') ORDER BY ord LIMIT 50) m
        LEFT JOIN documents d ON d.doc_id = m.page_id AND d.lang = 'en'""",
)
def limit_before_load(spark, sf):
    rows = src.layout_samples(
        written_manifest(spark, sf), english_notes(spark, sf), domains=["en", "fr"], limit=50, absent="keep"
    )
    return rows.select("ord", "page_id", "domain", F.col("annotation").isNotNull().alias("loaded"))


@query(
    "S07_limit_after_load",
    f"""SELECT m.ord, m.page_id, m.domain FROM ({SQL_MANIFEST}) m JOIN documents d ON d.doc_id = m.page_id AND d.lang = 'en'
        WHERE domain IN ('en', 'fr') ORDER BY ord LIMIT 50""",
)
def limit_after_load(spark, sf):
    rows = src.layout_samples(
        written_manifest(spark, sf), english_notes(spark, sf), domains=["en", "fr"], limit=50, absent="skip"
    )
    return rows.select("ord", "page_id", "domain")


def write_named(df, path="path", value="value"):
    """One file per row, at the row's path."""
    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        n = 0
        for batch in batches:
            for at, text in zip(batch.column(path).to_pylist(), batch.column(value).to_pylist()):
                store, inner = fs.FileSystem.from_uri(at) if "://" in at or at.startswith("file:") else (fs.LocalFileSystem(), at)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                with store.open_output_stream(inner) as f:
                    f.write(text.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.select(path, value).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0]


@query(
    "S08_coco_annotations",
    """SELECT 'p' || doc_id // 20 AS page_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS idx,
         CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'figure' END AS kind,
         n_chars % 700 AS x, doc_id % 20 * 60 AS y, 100 + n_chars % 50 AS w, 50::BIGINT AS h
       FROM documents WHERE doc_id // 20 % 3 <> 1""",
)
def coco_annotations(spark, sf):
    """Annotation files of the documents, twenty to a page, in both spellings of the envelope. A third
    of the pages have a file that the manifest does not name and that no reader could parse."""
    folder = work_folder(spark, "snapshot")
    d, page = rel.table(spark, sf, "documents"), F.floor(F.col("doc_id") / 20)
    box = F.array(*[c.cast("double") for c in (
        F.col("n_chars") % 700, F.col("doc_id") % 20 * 60, 100 + F.col("n_chars") % 50, F.lit(50))])
    mark = F.struct(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("category_id"), box.alias("bbox"))
    pages = d.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    names = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(("Text", "Table", "figure"))])
    key = lambda name: F.to_json(F.struct(F.col("marks").alias(name), names.alias("categories")))
    body = F.when(F.col("page") % 3 == 1, "{torn").when(F.col("page") % 2 == 0, key("annotations")).otherwise(key("layout_dets"))
    named = pages.select(F.concat(F.lit("p"), F.col("page").cast("string")).alias("page_id"), "page", body.alias("value"))
    write_named(named.withColumn("path", src.annotation_path(folder, F.col("page_id"))))
    listed = named.where(F.col("page") % 3 != 1).select(F.col("page").alias("ord"), "page_id", F.lit("docs").alias("domain"))
    samples = src.load_layout(spark, folder, listed)
    return pay.coco_blocks(samples, "annotation", ["page_id"]).select(
        "page_id", F.col("idx").cast("bigint").alias("idx"), "kind",
        *[F.col(f"bbox.{c}").cast("bigint").alias(c) for c in ("x", "y", "w", "h")],
    )


@query(
    "S09_bucket_sizes",
    with_relations(
        "tags",
        """SELECT b.ord, b.name, count(DISTINCT qid) AS n_qs FROM (SELECT DISTINCT ord, name
             FROM bucket_tags) b LEFT JOIN bucket_map m ON m.ord = b.ord GROUP BY b.ord, b.name""",
        bucket_tags=SQL_BUCKETS, bucket_map=SQL_BUCKET_MAP,
    ),
)
def bucket_sizes(spark, sf):
    return metrics.bucket_sizes(rel.bank(spark, sf), buckets(spark))


@query(
    "S11_registry_union",
    """SELECT s_name AS id, 'supplier' AS shape FROM supplier
       UNION ALL SELECT c_name, 'customer' FROM customer""",
)
def registry_union(spark, sf):
    from gradeline.sources.dimensions import registry

    s = rel.table(spark, sf, "supplier").select(F.col("s_name").alias("id"),
                                                F.lit("supplier").alias("shape"))
    c = rel.table(spark, sf, "customer").select(F.col("c_name").alias("id"),
                                                F.lit("customer").alias("shape"))
    return registry(s, c).select("id", "shape")


@query(
    "S12_cell_round_trip",
    with_lines(
        """SELECT page_id::VARCHAR AS page_id, processor, pred_type, gt_type, count(*) AS n FROM lines
           WHERE hit AND NOT same GROUP BY ALL"""
    ),
)
def cell_round_trip(spark, sf):
    conf = lay.confusion(pairs(spark, sf), ["page_id", "processor"])
    key = F.concat_ws("|", "pred_type", "gt_type")
    cells = conf.groupBy("page_id", "processor").agg(
        F.struct(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("confusion"))
        .alias("structural")
    )
    back = src.parse_cells(src.cell_json(cells))
    return src.confusion_long(back)


@query(
    "S12_cell_scores",
    with_lines(
        f"""SELECT page_id::VARCHAR AS page_id, processor, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn,
             round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, misses::BIGINT AS misses,
             hallucinations::BIGINT AS hallucinations, coalesce(per_class, '') AS per_class
           FROM cells_l LEFT JOIN (SELECT page_id, processor, {CLASS_TEXT} AS per_class FROM class_l
             GROUP BY page_id, processor) USING (page_id, processor)""",
        **{k: CELL_SQL[k] for k in ("cells_l", "class_l")},
    ),
)
def cell_scores(spark, sf):
    cells = lay.evaluate_cells(pairs(spark, sf)).select(
        F.col("page_id").cast("string").alias("page_id"), "processor", "strict", "per_class",
        F.struct("misses", "hallucinations", "misclassifications", "confusion").alias("structural"),
    )
    back = src.parse_cells(src.cell_json(cells))
    return back.select(
        "page_id", "processor", "strict.tp", "strict.fp", "strict.fn", F.round("strict.f1", 6).alias("f1"),
        "structural.misses", "structural.hallucinations", shown_classes(F.col("per_class")).alias("per_class"),
    )


@query(
    "S13_processors_present",
    with_lines("SELECT DISTINCT processor FROM lines WHERE n_pred > 0"),
)
def processors_present(spark, sf):
    return src.processors_present(predictions(spark, sf))


# -- parts of larger operators under their own names -------------------------------------------


@query(
    "L06_micro_pooling",
    with_lines(
        f"""SELECT *, {prf_sql('tp', 'fp', 'fn')} FROM (SELECT class,
             CAST(sum(t) AS BIGINT) AS tp, CAST(sum(p) - sum(t) AS BIGINT) AS fp,
             CAST(sum(g) - sum(t) AS BIGINT) AS fn FROM sides GROUP BY class)""",
        sides=SIDES,
    ),
)
def micro_pooling(spark, sf):
    rows = lay.per_class_f1(pairs(spark, sf), ["processor"])
    return lay.pooled(rows, ["class"]).withColumns(R6("precision", "recall", "f1"))


@query(
    "L08_merge_records",
    with_lines(
        """SELECT page_id, processor, ln AS target, px AS x, ln * 60 AS y, w,
             round(greatest(vl, vr), 6) AS before, round(vu, 6) AS after FROM lines WHERE healed"""
    ),
)
def merge_records(spark, sf):
    r = lay.recover_matches(pairs(spark, sf)).select(
        "page_id", "processor", "gt", F.inline("splits")
    )
    return r.select(
        "page_id", "processor", F.element_at("gt", F.col("target") + 1)["idx"].alias("target"),
        *[F.col(f"bbox.{c}").cast("bigint").alias(c) for c in ("x", "y", "w")],
        F.round("before", 6).alias("before"), F.round("after", 6).alias("after"),
    )


@query(
    "L11_two_strict_counts",
    with_lines(
        """SELECT processor, sum((hit AND same)::INT)::BIGINT AS typed_tp,
             sum(hit::INT)::BIGINT AS kept_tp FROM lines GROUP BY processor"""
    ),
)
def two_strict_counts(spark, sf):
    m = lay.match_blocks(pairs(spark, sf))
    return m.groupBy("processor").agg(
        F.sum(F.size(F.filter("matched", lay.same_kind))).cast("bigint").alias("typed_tp"),
        F.sum(F.size("matched")).cast("bigint").alias("kept_tp"),
    )


RATE = "coalesce(count(*) FILTER (WHERE {0}) / nullif(count(*) FILTER (WHERE {1}), 0), 0)"
ROW_RATES = {
    "checkbox_acc": ("box AND ok", "box"), "checked_acc": ("box AND gold_true AND ok", "box AND gold_true"),
    "unchecked_acc": ("box AND NOT gold_true AND ok", "box AND NOT gold_true"), "null_acc": ("nul AND ok", "nul"),
    "hallucination_rate": ("nul AND off", "nul AND status <> 'error'"), "general_field_acc": ("ok", "true"),
}
ROW_COUNTS = {
    "tt": "box AND gold_true AND ok", "tf": "box AND gold_true AND off", "ft": "box AND NOT gold_true AND off",
    "ff": "box AND NOT gold_true AND ok", "err": "box AND status = 'error'",
}
ROW_BOUNDS = [f"{f}_{b}" for f in ("checkbox", "null") for b in ("lo", "hi")]


@query(
    "R01_row_metrics",
    with_relations(
        "fields cells rows",
        "SELECT w.*, s.strict_question_acc, s.n_seen, s.n_expected, s.n_seen < s.n_expected AS incomplete, error_classes, "
        + ", ".join(ROW_BOUNDS)
        + """, m.verdict AS beats_majority FROM (SELECT parser, """
        + ", ".join(f"round({RATE.format(*c)}, 6) AS {n}" for n, c in ROW_RATES.items())
        + ", " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in ROW_COUNTS.items())
        + f""", count(DISTINCT doc) FILTER (WHERE box) AS checkbox_docs, count(DISTINCT doc) FILTER (WHERE nul) AS null_docs
             FROM flagged GROUP BY parser) w
           JOIN (SELECT parser, count(*) FILTER (WHERE NOT missing) AS n_seen, count(*) AS n_expected,
               round(count(*) FILTER (WHERE NOT missing AND has_answer AND match) / count(*), 6) AS strict_question_acc
             FROM cells LEFT JOIN (SELECT q, p, match FROM rows) USING (q, p) GROUP BY parser) s USING (parser)
           JOIN (SELECT parser, string_agg(class || ' ' || n, ', ' ORDER BY class) AS error_classes FROM (
               SELECT parser, {SQL_ERROR_CLASS} AS class, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY parser) e USING (parser)
           JOIN (SELECT parser, """
        + ", ".join(
            f"round(quantile_cont(c / n, {q}) FILTER (WHERE flag = '{f}'), 6) AS {f}_{b}"
            for f in ("checkbox", "null") for b, q in (("lo", 0.025), ("hi", 0.975))
        )
        + f""" FROM stats GROUP BY parser) b USING (parser)
           JOIN (SELECT parser, verdict FROM ({ORACLES['B05_beats_majority']})) m USING (parser)""",
        flagged="""SELECT *, checkbox AND kind = 'bool' AS box, kind = 'null' AS nul, status = 'correct' AS ok,
            status = 'incorrect' AS off FROM fields""",
        docs="""SELECT parser, CASE WHEN box THEN 'checkbox' ELSE 'null' END AS flag, doc, count(*) AS n,
            count(*) FILTER (WHERE ok) AS c FROM flagged WHERE box OR nul GROUP BY 1, 2, 3""",
        **sql_resample("docs", "parser, flag", ["n", "c"]),
    ),
)
def row_metrics(spark, sf):
    wide = reports.row_metrics(rel.bank(spark, sf), rel.scored(spark, sf), SYSTEMS)
    classes = F.transform(
        F.array_sort(F.map_entries("error_classes")), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))
    )
    return wide.withColumns(
        R6(*ROW_RATES, *ROW_BOUNDS, "strict_question_acc") | {"error_classes": F.array_join(classes, ", ")}
    )


# -- rewriting stored tables -------------------------------------------------------------------


@query(
    "C05_rescored_table",
    with_relations(
        "rows",
        """SELECT parser, count(*) AS examined, count(*) FILTER (WHERE has_answer AND q % 13 = 0 AND match) AS changed,
             count(*) FILTER (WHERE has_answer AND match) AS n_match FROM rows GROUP BY parser""",
    ),
)
def rescored_table(spark, sf):
    """Stored verdicts of an older rule, rewritten by the current one and read back."""
    table = work_folder(spark, "stored")
    old = rel.stored(spark, sf).withColumn("match", F.col("match") & ~(F.col("q") % 13 == 0))
    stored = old.select("qid", "parser", "field_matches", "match", "has_answer", "answer")
    src.write_snapshot(stored, table)
    counts = rewrite.rescore_table(spark, rel.bank(spark, sf, with_gold=True), table)
    now = spark.read.parquet(table).groupBy("parser").agg(F.count_if("match").alias("n_match"))
    return counts.drop("skipped").join(now, "parser")


@query(
    "J10_archived_generation",
    with_relations(
        "rows",
        """SELECT CASE WHEN p < 3 THEN 'live' WHEN q % 4 = 0 THEN 'unstamped' ELSE 'gen-1' END AS place, parser,
             count(*) AS n FROM rows GROUP BY 1, 2
           UNION ALL SELECT 'gen-0', parser, count(*) FROM rows WHERE p >= 4 AND q % 9 = 0 GROUP BY parser""",
    ),
)
def archived_generation(spark, sf):
    """Rows of an older extractor moved to an archive that holds an earlier generation."""
    table, archive = work_folder(spark, "live"), work_folder(spark, "archive")
    stored = rel.scored(spark, sf).withColumn("extractor", F.when(F.col("q") % 4 != 0, F.lit("gen-1")))
    src.write_snapshot(stored, table)
    stored.where("p >= 4 AND q % 9 = 0").withColumn("generation", F.lit("gen-0")).write.partitionBy(*rewrite.PLACE).parquet(archive)
    rewrite.archive_generation(spark, table, archive, "gen-2")
    count = lambda rows, place: rows.groupBy(place.alias("place"), "parser").agg(F.count("*").alias("n"))
    return count(spark.read.parquet(table), F.lit("live")).unionByName(count(spark.read.parquet(archive), F.col("generation")))


# -- streaming ---------------------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark, sf):
    return as_answers(spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf))


def as_answers(events):
    p = (F.col("user_id") % 6).cast("int")
    return events.select(
        "event_id", F.col("ts").alias("retrieved_at"),
        F.element_at(F.array(*[F.lit(s) for s in SYSTEMS]), p + 1).alias("parser"),
        F.concat(F.lit("q"), F.col("user_id").cast("string"), F.col("event_type")).alias("qid"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_sec"),
        (F.col("value") / 100).alias("cost"),
    )


SQL_EVENTS = (
    "SELECT *, CASE user_id % 6 " + " ".join(
        f"WHEN {i} THEN '{s}'" for i, s in enumerate(SYSTEMS)
    ) + " END AS parser FROM events"
)


@query(
    "ST1_stream_scoring",
    with_relations(
        "rows",
        """SELECT parser, count(*) AS n_cells, sum(n_fields)::BIGINT AS n_fields,
             sum(n_matched)::BIGINT AS n_matched FROM rows WHERE has_answer GROUP BY parser""",
    ),
)
def stream_scoring(spark, sf):
    arrivals, out = work_folder(spark, "arrivals"), work_folder(spark, "scored")
    rel.answers(spark, sf).select("qid", "parser", "has_answer", F.to_json("answer").alias("a")) \
        .write.parquet(arrivals)
    stream = spark.readStream.schema(
        "qid string, parser string, has_answer boolean, a string"
    ).parquet(arrivals)
    answers = stream.select("qid", "parser", "has_answer", F.parse_json("a").alias("answer"))
    bank = rel.bank(spark, sf, with_gold=True)
    verdicts = live.score_answer_stream(bank, answers).select("qid", "parser", "key", "ok")
    live.write_batches(verdicts, out, "append")
    return live.read_batches(spark, out).groupBy("parser").agg(
        F.count_distinct("qid").alias("n_cells"), F.count("*").alias("n_fields"),
        F.count_if("ok").alias("n_matched"),
    )


def arrivals(spark, sf, deliver):
    """Runs ``deliver(stream, run)`` three times, as a third of the event days arrives each time. One
    event in ten is delivered a third late."""
    folder = work_folder(spark, "arrivals")
    events = rel.table(spark, sf, "events")
    day = F.unix_date(F.to_date("ts"))
    first = events.agg(F.min(day)).scalar()
    third = F.least(F.floor((day - first) / 10), F.lit(2)) + (F.col("event_id") % 10 == 1).cast("int")
    rows = events.withColumns({"third": third, "ts": F.col("ts").cast("timestamp")})
    for run in range(3):
        rows.where(F.col("third") == run).drop("third").write.mode("append").parquet(folder)
        deliver(as_answers(spark.readStream.schema(EVENTS).parquet(folder)), run)


# The third of an event and the watermark that it meets: three days before the latest one delivered.
SQL_THIRDS = f"""SELECT *, least(2, (ts::DATE - (SELECT min(ts)::DATE FROM events)) // 10) + (event_id % 10 = 1)::INT AS third
  FROM ({SQL_EVENTS})"""
SQL_MARKS = "SELECT third + 1 AS third, max(max(ts)) OVER (ORDER BY third) - INTERVAL 3 DAY AS mark FROM thirds GROUP BY third"


@query(
    "ST2_first_per_cell",
    f"""WITH thirds AS ({SQL_THIRDS}), marks AS ({SQL_MARKS})
        SELECT parser, count(*) AS n_cells FROM thirds LEFT JOIN marks USING (third)
        WHERE third < 3 AND (mark IS NULL OR ts >= mark) GROUP BY parser""",
)
def first_per_cell(spark, sf):
    """Events as cells, each sent twice; late ones count while the watermark has not passed them."""
    out = work_folder(spark, "cells")

    def deliver(stream, run):
        twice = stream.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
        once = live.first_per_cell(twice.withColumn("qid", F.concat("qid", F.col("event_id").cast("string"))), delay="3 days")
        live.write_batches(once, out, "append")

    arrivals(spark, sf, deliver)
    return live.read_batches(spark, out).groupBy("parser").agg(F.count("*").alias("n_cells"))


@query(
    "ST3_live_accuracy",
    f"""SELECT w AS start, w + INTERVAL 1 DAY AS end, parser, count(*) AS n,
          count(*) FILTER (WHERE event_type <> 'error') AS n_ok,
          round(avg((event_type <> 'error')::INT), 6) AS accuracy,
          round(sum(value), 2) AS total_latency
        FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts)
          - INTERVAL 12 HOUR]) AS w FROM ({SQL_EVENTS})) GROUP BY w, parser""",
)
def live_accuracy(spark, sf):
    out = work_folder(spark, "live")
    agg = live.live_accuracy(event_stream(spark, sf), length="1 day", slide="12 hours")
    live.write_batches(agg, out, "update")
    rows = live.newest(live.read_batches(spark, out), ["start", "end", "parser"])
    # The total has two decimals; a mean of such values can end in an exact half.
    total = F.round(F.col("mean_latency") * F.col("n"), 2)
    return rows.withColumns({"total_latency": total, **R6("accuracy")}).drop("mean_latency")


@query(
    "ST4_spend_watch",
    f"""WITH thirds AS (SELECT *, date_trunc('hour', ts) AS slot, third - (event_id % 10 = 1)::INT AS own FROM ({SQL_THIRDS})),
        marks AS (SELECT third + 1 AS third, max(max(slot)) OVER (ORDER BY third) - INTERVAL 3 DAY AS mark FROM thirds GROUP BY third),
        counted AS (SELECT *, CASE WHEN event_id % 499 <> 7 THEN value / 100 END AS cost
          FROM thirds LEFT JOIN marks USING (third) WHERE third < 3 AND (mark IS NULL OR slot > mark)),
        runs AS (SELECT parser || '/' || own AS run, min(slot) FILTER (third = own) AS since, max(slot) AS last,
          sum(cost) AS cost, count(*) - count(cost) AS n_unknown, count(*) AS n FROM counted GROUP BY run)
        SELECT run, since, last, round(cost, 4) AS cost, n_unknown, n, cost > 5 OR n_unknown > 0 AS stopped,
          last + INTERVAL 1 DAY <= (SELECT max(mark) FROM marks WHERE third <= 3) AS closed FROM runs""",
)
def spend_watch(spark, sf):
    """One run per system and third of the days. Late events count until the watermark has passed
    them, and a run without events for a day is closed."""
    out = work_folder(spark, "spend")
    first = rel.table(spark, sf, "events").agg(F.min(F.unix_date(F.to_date("ts")))).scalar()

    def deliver(stream, run):
        day = F.unix_date(F.to_date("retrieved_at"))
        own = F.least(F.floor((day - first) / 10), F.lit(2)).cast("string")
        rows = stream.withColumns({
            "run": F.concat("parser", F.lit("/"), own), "cost": F.when(F.col("event_id") % 499 != 7, F.col("cost")),
        })
        live.spend_batches(live.spend_watch(rows, 5.0, by="run", delay="3 days", quiet_hours=24), out)

    arrivals(spark, sf, deliver)
    found = live.newest(live.read_batches(spark, out), ["run", "since"])
    return found.withColumn("cost", F.round("cost", 4))


@query(
    "ST5_collection_sessions",
    f"""SELECT min(ts) AS start, parser, count(*) AS n, max(ts) AS last FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY parser ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
          FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY parser ORDER BY ts)
            >= INTERVAL 30 MINUTE)::INT, 0) AS fresh FROM ({SQL_EVENTS}))) GROUP BY parser, s""",
)
def collection_sessions(spark, sf):
    """Every session: those that the watermark has closed and those still open at the end."""
    out = work_folder(spark, "sessions")
    s = live.collection_sessions(event_stream(spark, sf), gap="30 minutes", delay="1 day")
    live.write_batches(s, out, "complete")
    return live.latest(live.read_batches(spark, out))
