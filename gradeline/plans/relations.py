"""Evaluation relations derived from the supplied tables, for Spark and for the SQL check.

The supplied tables hold no question bank and no answers, so both are derived by integer
arithmetic that Spark SQL and DuckDB evaluate alike: an order is a question, its line numbers are
the gold fields, its customer is the document. Six systems answer every question. The moduli decide
the *state* of a cell (no row, error, wrong, key left out); every gold field of the whole table
stays in every result.

``SQL`` holds the same relations as common table expressions for the check. They are long-form and
never build JSON, so they do not share the operators' code path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Six systems: three direct legs (one entry under two conditions), one compatible transcriber, one
# upstream parser, one that no registry knows.
SYSTEMS = [
    "vlm__alpha-8b@cloud__0a1b2c3d4e5f",
    "vlm__beta-xl@cloud__0a1b2c3d4e5f",
    "vlm__beta-xl@cloud__ffee00112233",
    "alpha-ocr_cloud__0a1b2c3d4e5f",
    "scanner_pro",
    "mystery_ocr",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def facts(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """One row per (order, line number): the pair repeats in the input, so it is aggregated.

    Lines are dealt by order once, as given: the pairs, the join and every grouping by order that
    follows find their rows in place. ``parts`` fixes the number of partitions, for heavy work on
    small rows that Spark would put together by their bytes.
    """
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey", "l_suppkey")
    line = (line.repartition(parts, "l_orderkey") if parts else line.repartition("l_orderkey")).groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"),
        F.min("l_quantity").cast("bigint").alias("qty"),
        F.min("l_partkey").alias("pk"),
        F.min("l_suppkey").alias("sk"),
    )
    order = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("q"),
        F.col("l_linenumber").alias("ln"),
        F.col("o_custkey").alias("d"),
        F.col("o_orderpriority").alias("domain"),
        "flag", "qty", "pk", "sk",
    )


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Lines that a task of heavy work on them gets, whatever the size of the table.
LINES_PER_TASK = 150_000


def line_parts(spark: SparkSession, sf: str) -> int:
    """Partitions of heavy work on lines: those of the session, and more for a larger table, so that
    a task's lines fit its memory at every size. The count comes from the footers of the files."""
    return max(shuffle_parts(spark), -(-table(spark, sf, "lineitem").count() // LINES_PER_TASK))


LINE = ("ln", "flag", "qty", "pk", "sk")


def questions(spark: SparkSession, sf: str, **made: Column) -> DataFrame:
    """One row per order with its lines as an array (a line number occurs once, so at most seven).

    ``made`` names columns worked out of each line that go along: once there, and not once per system.
    """
    lines = facts(spark, sf).withColumns(made) if made else facts(spark, sf)
    return lines.groupBy("q", "d", "domain").agg(
        F.array_sort(F.collect_list(F.struct(*LINE, *made))).alias("lines")
    )


def own_line() -> dict[str, Column]:
    """The fields of a row of :func:`facts`."""
    return {c: F.col(c) for c in LINE}


def capabilities(q: Column) -> Column:
    first = F.when(q % 3 == 0, "checkbox_state").when(q % 3 == 1, "blank_field").otherwise("table")
    return F.split(
        F.concat(
            first,
            F.when(q % 5 == 0, ",blank_field").otherwise(""),
            F.when(q % 7 == 0, ",form_checkbox_grid").otherwise(""),
            F.when(q % 11 == 0, ",handwriting").otherwise(""),
        ),
        ",",
    )


def gold_kind(ln: Column) -> Column:
    return (
        F.when(ln % 4 == 0, "bool").when(ln % 4 == 1, "num").when(ln % 4 == 2, "str")
        .otherwise("null")
    )


def gold_string(line: Column) -> Column:
    return F.concat(
        F.lit("lot "), line["pk"].cast("string"), F.lit(" from supplier "),
        line["sk"].cast("string"), F.lit(" flag "), line["flag"],
    )


def gold_json(line: Column) -> Column:
    return (
        F.when(line["ln"] % 4 == 0, F.when(line["flag"] == "R", "true").otherwise("false"))
        .when(line["ln"] % 4 == 1, line["qty"].cast("string"))
        .when(line["ln"] % 4 == 2, F.concat(F.lit('"'), gold_string(line), F.lit('"')))
        .otherwise("null")
    )


def key_of(line: Column) -> Column:
    return F.concat(F.lit("f"), line["ln"].cast("string"))


def bank(spark: SparkSession, sf: str, *, with_gold: bool = False) -> DataFrame:
    """The question bank; gold values as VARIANT only where asked for."""

    def field(line: Column) -> Column:
        parts = [
            key_of(line).alias("key"),
            gold_kind(line["ln"]).alias("gold_kind"),
            F.when(line["ln"] % 4 == 0, line["flag"] == "R").alias("gold_true"),
            (line["ln"] % 4 == 2).alias("is_string"),
        ]
        if with_gold:
            parts.append(F.parse_json(line["gold"]).alias("gold"))
        return F.struct(*parts)

    made = {"gold": gold_json(own_line())} if with_gold else {}
    return questions(spark, sf, **made).select(
        F.concat(F.lit("q"), F.col("q").cast("string")).alias("qid"),
        F.concat(F.lit("d"), F.col("d").cast("string")).alias("doc"),
        "domain",
        capabilities(F.col("q")).alias("capabilities"),
        F.transform("lines", field).alias("fields"),
        "q",
    )


def _cells(spark: SparkSession, sf: str, **made: Column) -> DataFrame:
    """Stored rows: every question and system except the cells nobody ran."""
    q, p = F.col("q"), F.col("p")
    return (
        questions(spark, sf, **made)
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(5))))
        .where((q + p) % 53 != 0)
        .withColumn("failed", (q * 13 + p * 7) % 41 == 0)
        .withColumn("junk", (q * 7 + p) % 97 == 0)
        .withColumn("parser", F.element_at(F.array(*[F.lit(s) for s in SYSTEMS]), p + 1))
    )


def _wrong(line: Column, q: Column, p: Column) -> Column:
    return (q * 31 + line["ln"] * 17 + p * 11) % (7 + 2 * p) == 0


def _absent(line: Column, q: Column, p: Column) -> Column:
    return (q + line["ln"] * 5 + p) % 29 == 0


def _null_answer(line: Column, q: Column, p: Column) -> Column:
    """An explicit null: a right one for a null gold, or a wrong one now and then."""
    null_gold = line["ln"] % 4 == 3
    return F.when(_wrong(line, q, p), ~null_gold & (line["pk"] % 3 == 0)).otherwise(null_gold)


def _scored_columns() -> list[Column]:
    q, p = F.col("q"), F.col("p")
    has_answer = ~F.col("failed") | (q % 5 == 0)
    is_object = has_answer & ~F.col("junk")

    def verdict(line: Column) -> Column:
        null_gold = line["ln"] % 4 == 3
        ok = F.when(~is_object | _absent(line, q, p), null_gold).otherwise(~_wrong(line, q, p))
        return F.struct(key_of(line).alias("key"), ok.alias("ok"))

    matches = F.map_from_entries(F.transform("lines", verdict))
    nulls = F.transform(
        F.filter("lines", lambda x: ~_absent(x, q, p) & _null_answer(x, q, p)), key_of
    )
    direct = p < 3
    error = F.when(
        F.col("failed"),
        F.when(q % 3 == 0, "markdown missing").when(q % 3 == 1, "no answer").otherwise("timeout"),
    )
    error_class = F.when(
        direct,
        F.when(~F.col("failed"), "none").when(q % 2 == 0, "api_error").otherwise("parse_error"),
    )
    return [
        F.concat(F.lit("q"), q.cast("string")).alias("qid"),
        F.col("parser"),
        F.concat(F.lit("d"), F.col("d").cast("string")).alias("doc"),
        F.col("domain"),
        has_answer.alias("has_answer"),
        is_object.alias("is_object"),
        error.alias("error"),
        error_class.alias("error_class"),
        F.when(has_answer, matches).alias("field_matches"),
        F.when(is_object, nulls).otherwise(F.array().cast("array<string>")).alias("null_keys"),
        F.when(has_answer, F.forall(F.map_values(matches), lambda v: v)).alias("match"),
        q, p,
    ]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, already scored rows, as a scoring pass leaves them."""
    return _cells(spark, sf).select(*_scored_columns())


def _entries() -> dict[str, Column]:
    """The JSON entries of a line: its right answer, its wrong one and an explicit null."""
    line = own_line()
    qty, style = line["qty"].cast("string"), line["pk"] % 4
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = (
        F.when(style == 0, qty)
        .when(style == 1, quoted(F.concat(F.lit("$"), qty, F.lit(".00"))))
        .when(style == 2, quoted(F.concat(qty, F.lit("%"))))
        .otherwise(quoted(F.regexp_replace(qty, r"(\d)", "$1 ")))
    )
    pk, sk = line["pk"].cast("string"), line["sk"].cast("string")
    text = (
        F.when(style == 0, gold_string(line))
        .when(style == 1, F.concat(F.lit("**lot** "), pk, F.lit(" from<br/>supplier "), sk,
                                   F.lit(" flag "), line["flag"]))
        .when(style == 2, F.concat(F.lit("Lot "), pk, F.lit(", from supplier "), sk,
                                   F.lit(": Flag "), line["flag"], F.lit(".")))
        .otherwise(F.concat(F.lit("lot  "), pk, F.lit("   from supplier "), sk,
                            F.lit("  flag "), line["flag"]))
    )
    right = (
        F.when(line["ln"] % 4 == 0, gold_json(line)).when(line["ln"] % 4 == 1, number)
        .when(line["ln"] % 4 == 2, quoted(text)).otherwise("null")
    )
    off = (
        F.when(line["ln"] % 4 == 0, F.when(line["flag"] == "R", "false").otherwise("true"))
        .when(line["ln"] % 4 == 1, (line["qty"] + 1).cast("string"))
        .when(line["ln"] % 4 == 2, quoted(F.concat(F.lit("crate "), pk, F.lit(" to vendor "),
                                                   sk, F.lit(" mark unknown"))))
        .otherwise('"unreadable"')
    )
    entry = lambda body: F.concat(F.lit('"'), key_of(line), F.lit('": '), body)
    return {"right": entry(right), "off": entry(off), "none": entry(F.lit("null"))}


def _answer_column() -> Column:
    """The answer of a cell whose lines have their :func:`_entries`."""
    q, p = F.col("q"), F.col("p")

    def value(line: Column) -> Column:
        return (
            F.when(_null_answer(line, q, p), line["none"]).when(_wrong(line, q, p), line["off"])
            .otherwise(line["right"])
        )

    pairs = F.transform(F.filter("lines", lambda x: ~_absent(x, q, p)), value)
    text = F.when(F.col("junk"), '"n/a"').otherwise(
        F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    )
    has_answer = ~F.col("failed") | (q % 5 == 0)
    return F.when(has_answer, F.parse_json(text)).alias("answer")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows with the answer itself as VARIANT, with surface noise on right values."""
    return stored(spark, sf).select("qid", "parser", "has_answer", "answer")


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of :func:`scored` with their answers, as one stored row has both."""
    return _cells(spark, sf, **_entries()).select(*_scored_columns(), _answer_column())


# ---------------------------------------------------------------------------------------------
# The same relations for the SQL check.
# ---------------------------------------------------------------------------------------------

_CASE_SYSTEM = "CASE p " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SYSTEMS)) + " END"

SQL = {
    "facts": """
      SELECT l_orderkey AS q, l_linenumber AS ln, o_custkey AS d, o_orderpriority AS domain,
             min(l_returnflag) AS flag, CAST(min(l_quantity) AS BIGINT) AS qty,
             min(l_partkey) AS pk, min(l_suppkey) AS sk
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      GROUP BY l_orderkey, l_linenumber, o_custkey, o_orderpriority""",
    "gold": """
      SELECT q, ln, d, 'q' || q AS qid, 'f' || ln AS key, 'd' || d AS doc, domain, flag, qty, pk, sk,
             CASE ln % 4 WHEN 0 THEN 'bool' WHEN 1 THEN 'num' WHEN 2 THEN 'str' ELSE 'null' END
               AS kind,
             CASE WHEN ln % 4 = 0 THEN flag = 'R' END AS gold_true,
             (q % 3 = 0 OR q % 7 = 0) AS checkbox, (q % 3 = 1 OR q % 5 = 0) AS blank
      FROM facts""",
    "asked": """
      SELECT DISTINCT q, d, 'q' || q AS qid, 'd' || d AS doc, domain,
             (q % 3 = 0 OR q % 7 = 0) AS checkbox, (q % 3 = 1 OR q % 5 = 0) AS blank
      FROM facts""",
    "tags": """
      SELECT DISTINCT qid, q, doc, tag FROM (
        SELECT qid, q, doc, CASE q % 3 WHEN 0 THEN 'checkbox_state' WHEN 1 THEN 'blank_field'
               ELSE 'table' END AS tag FROM asked
        UNION ALL SELECT qid, q, doc, 'blank_field' FROM asked WHERE q % 5 = 0
        UNION ALL SELECT qid, q, doc, 'form_checkbox_grid' FROM asked WHERE q % 7 = 0
        UNION ALL SELECT qid, q, doc, 'handwriting' FROM asked WHERE q % 11 = 0)""",
    "cells": f"""
      SELECT *, {_CASE_SYSTEM} AS parser, (q + p) % 53 = 0 AS missing,
             (q * 13 + p * 7) % 41 = 0 AS failed, (q * 7 + p) % 97 = 0 AS junk,
             ((q * 13 + p * 7) % 41 <> 0 OR q % 5 = 0) AS has_answer
      FROM (SELECT *, unnest(range(0, 6)) AS p FROM asked)""",
    "marks": """
      SELECT g.*, c.p, c.parser, c.missing, c.failed, c.junk, c.has_answer,
             (g.q * 31 + g.ln * 17 + c.p * 11) % (7 + 2 * c.p) = 0 AS wrong,
             (g.q + g.ln * 5 + c.p) % 29 = 0 AS absent
      FROM gold g JOIN cells c ON g.q = c.q""",
    "fields": """
      SELECT *,
             CASE WHEN junk OR absent THEN kind = 'null' ELSE NOT wrong END AS matched,
             CASE WHEN missing OR failed OR junk THEN 'error'
                  WHEN kind = 'null' THEN
                    CASE WHEN NOT absent AND NOT wrong THEN 'correct' ELSE 'incorrect' END
                  WHEN NOT absent AND NOT wrong THEN 'correct' ELSE 'incorrect' END AS status
      FROM marks""",
    "rows": """
      SELECT c.*, s.n_fields, s.n_matched, s.n_fields = s.n_matched AS match,
             CASE WHEN c.failed THEN CASE c.q % 3 WHEN 0 THEN 'markdown missing'
                  WHEN 1 THEN 'no answer' ELSE 'timeout' END END AS error,
             CASE WHEN c.p < 3 THEN CASE WHEN NOT c.failed THEN 'none' WHEN c.q % 2 = 0
                  THEN 'api_error' ELSE 'parse_error' END END AS error_class
      FROM cells c JOIN (
        SELECT q, p, count(*) AS n_fields, count(*) FILTER (WHERE matched) AS n_matched
        FROM fields GROUP BY q, p) s ON c.q = s.q AND c.p = s.p
      WHERE NOT c.missing""",
}

_NEEDS = {
    "facts": [], "gold": ["facts"], "asked": ["facts"], "tags": ["asked"], "cells": ["asked"],
    "marks": ["gold", "cells"], "fields": ["marks"], "rows": ["cells", "fields"],
}


def with_relations(names: str, body: str, **extra: str) -> str:
    """``body`` behind the common table expressions it needs; ``extra`` adds more, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for m in _NEEDS[n]:
            visit(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
