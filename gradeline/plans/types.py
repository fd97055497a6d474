"""Queries over typing functions, comparators and JSON text.

Inputs are spelled from table columns; the check states the expected value of each spelling.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.functions import compare as cmp
from gradeline.functions import jsontext as js
from gradeline.functions import text as tx
from gradeline.functions import typing as ty
from gradeline.operators.typing_bank import type_bank
from gradeline.plans import relations as rel
from gradeline.plans.catalog import query


def pick(selector, *spellings):
    """One of several spellings per row."""
    out = F.when(selector == 0, spellings[0])
    for i, s in enumerate(spellings[1:], 1):
        out = out.when(selector == i, s)
    return out


def pick_sql(selector: str, *values: str) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def part(spark, sf):
    return rel.table(spark, sf, "part")


@query(
    "T01_placeholder_hint",
    "SELECT p_partkey, " + pick_sql(
        "p_partkey % 8", "'number'", "'one of: ' || p_type || ' | ' || p_brand",
        "'date string YYYY-MM-DD | null'", "'boolean'", "'boolean | null'", "'string | null'",
        "'string'", "'integer | null'",
    ) + " AS hint FROM part",
)
def placeholder_hint(spark, sf):
    t, b, n = F.col("p_type"), F.col("p_brand"), F.col("p_name")
    raw = pick(
        F.col("p_partkey") % 8, F.lit(" Amount "),
        F.concat(t, F.lit(" | "), b, F.lit("| "), F.lower(t), F.lit("|"), F.upper(b)),
        F.lit("null | MM/DD/YYYY"), F.lit("FALSE|true"), F.lit("true | null | false"),
        F.lit(" null | "), n, F.lit("qty | NULL"),
    )
    return part(spark, sf).select("p_partkey", ty.placeholder_hint(raw).alias("hint"))


@query(
    "T02_response_placeholder",
    "SELECT p_partkey, " + pick_sql(
        "p_partkey % 8", "p_name || ' | ' || p_brand", "'date'", "'text'", "'number'", "'integer'",
        "p_type || ' | none'", "'text'", "'a|b'",
    ) + " AS body FROM part",
)
def response_placeholder(spark, sf):
    t, b, n = F.col("p_type"), F.col("p_brand"), F.col("p_name")
    rf = pick(
        F.col("p_partkey") % 8, F.concat(n, F.lit(" / "), b), F.lit("(MM/DD/YYYY)"),
        F.lit("xxx-xx"), F.lit("a dollar amount"), F.lit("Integer"),
        F.concat(F.lit("use <"), t, F.lit("> or <none>")), n, F.lit("<a|b>"),
    )
    return part(spark, sf).select("p_partkey", ty.response_placeholder(rf).alias("body"))


@query(
    "T03_coerce_value",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         CASE l_linenumber WHEN 1 THEN 'num' WHEN 2 THEN 'num' WHEN 3 THEN 'bool' WHEN 4 THEN 'null'
           WHEN 5 THEN 'str' WHEN 6 THEN 'num' ELSE 'str' END AS kind,
         CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_extendedprice
           WHEN 6 THEN -l_quantity END AS num,
         CASE l_linenumber WHEN 3 THEN CASE l_returnflag WHEN 'R' THEN 'true' ELSE 'false' END
           WHEN 5 THEN CASE l_returnflag WHEN 'R' THEN 'Returned' ELSE 'kept' END
           WHEN 7 THEN strftime(l_shipdate, '%Y-%m-%d') END AS txt
       FROM lineitem""",
)
def coerce_value(spark, sf):
    ln, ret = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    qty = F.col("l_quantity").cast("bigint").cast("string")
    raw = pick(
        ln - 1, F.concat(F.lit("$ "), qty, F.lit(" %")),
        F.format_number("l_extendedprice", 2),
        F.when(ret, " Checked").otherwise("NO"), F.when(ret, "-").otherwise("N/A"),
        F.when(ret, "RETURNED").otherwise("kept"), F.concat(F.lit("-"), qty),
        F.date_format("l_shipdate", "MMMM d, yyyy"),
    )
    hint = pick(
        ln - 1, F.lit("integer"), F.lit("number | null"), F.lit("boolean"), F.lit("number"),
        F.lit("one of: Returned | Open"), F.lit("number"), F.lit("date string YYYY-MM-DD"),
    )
    rows = rel.table(spark, sf, "lineitem").withColumn("v", ty.coerce_value(raw, hint))
    kind, text = cmp.value_kind(F.col("v")), cmp.value_text(F.col("v"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", kind.alias("kind"),
        F.when(kind == "num", text.try_cast("double")).alias("num"),
        F.when(kind.isin("bool", "str"), text).alias("txt"),
    )


@query(
    "T04_iso_date",
    """SELECT o_orderkey, CASE o_orderkey % 10
         WHEN 8 THEN NULL
         WHEN 6 THEN CASE WHEN day(o_orderdate) <= 12
           THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)),
             '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""",
)
def iso_date(spark, sf):
    d = F.col("o_orderdate")
    spelled = pick(
        F.col("o_orderkey") % 10, F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy/M/d"),
        F.date_format(d, "MM.dd.yyyy"), F.concat(F.date_format(d, "MMMM d, yyyy"), F.lit(".")),
        F.date_format(d, "d MMM yyyy"), F.date_format(d, "M/d/yy"),
        # Day first: read as month first whenever that is a date.
        F.date_format(d, "d/M/yyyy"),
        F.regexp_replace(F.date_format(d, "MMM d yyyy"), "Sep", "Sept"),
        F.concat(F.date_format(d, "yyyy"), F.lit("-13-45")), F.date_format(d, "MM-dd-yyyy"),
    )
    return rel.table(spark, sf, "orders").select("o_orderkey", ty.iso_date(spelled).alias("iso"))


@query(
    "T05_widen_types",
    "SELECT p_partkey, " + pick_sql(
        "p_partkey % 6", "'string | null'", "'date string YYYY-MM-DD'", "'string'", "'string'",
        "'one of: small | large'", "'number'",
    ) + " AS hint, " + pick_sql(
        "p_partkey % 6", "p_name", "'2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')",
        "p_name", "p_brand", "'SMALL'", "CAST(p_size AS VARCHAR)",
    ) + " AS gold FROM part",
)
def widen_types(spark, sf):
    sel = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    day = F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")
    hint = pick(
        sel, F.lit("number | null"), F.lit("integer"), F.lit("date string YYYY-MM-DD"),
        F.lit("one of: small | large"), F.lit("one of: small | large"), F.lit("number"),
    )
    gold = pick(
        sel, F.col("p_name"), F.concat(F.lit("Jan "), day, F.lit(", 2024")), F.col("p_name"),
        F.col("p_brand"), F.lit("SMALL"), size,
    )
    kind = F.when(sel == 5, "num").otherwise("str")
    return part(spark, sf).select(
        "p_partkey", ty.widen_hint(hint, kind, gold).alias("hint"),
        ty.widen_gold(hint, kind, gold).alias("gold"),
    )


@query(
    "T06_render_template",
    """SELECT p_partkey, '{' || chr(10) || '  "' || p_name || '": <number>,' || chr(10) || '  "size'
         || p_size || '": <string>' || chr(10) || '}' AS template FROM part""",
)
def render_template(spark, sf):
    field = lambda k, h: F.struct(k.alias("key"), F.lit(h).alias("hint"))
    fields = F.array(
        field(F.col("p_name"), "number"),
        field(F.concat(F.lit("__"), F.col("p_type")), "string"),
        field(F.concat(F.lit("size"), F.col("p_size").cast("string")), "string"),
    )
    return part(spark, sf).select("p_partkey", ty.render_template(fields).alias("template"))


@query(
    "T07_type_bank",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept'
         ELSE '{' || chr(10) || '  "answer": <' || CASE p_partkey % 3 WHEN 1 THEN 'number'
           ELSE 'string' END || '>' || chr(10) || '}' END AS template,
         CASE p_partkey % 3 WHEN 0 THEN 'stays' WHEN 1 THEN CAST(p_size AS VARCHAR)
           ELSE p_brand END AS gold FROM part""",
)
def type_bank_query(spark, sf):
    k = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    raw = part(spark, sf).select(
        "p_partkey",
        F.when(k == 1, "a dollar amount").otherwise("small / large").alias("response_format"),
        F.when(k == 1, F.concat(F.lit("$"), size)).otherwise(F.col("p_brand")).alias("gold_answer"),
        F.when(k == 0, "kept").alias("template"),
        F.when(k == 0, F.parse_json(F.lit('{"answer": "stays"}'))).alias("gold"),
    )
    typed = type_bank(type_bank(raw))
    return typed.select(
        "p_partkey", "template",
        F.try_variant_get("gold", "$.answer", "string").alias("gold"),
    )


@query(
    "T08_build_template",
    """SELECT p_partkey, '{' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '  "amount": <number>,'
         || chr(10) || '  "name": <one of: ' || p_name || ' | none>,' || chr(10)
         || '  "due": <string | null>' ELSE '  "rows": <list of strings>,' || chr(10)
         || '  "what": <string>' END || chr(10) || '}' AS template,
         CASE WHEN p_partkey % 2 = 0 THEN 'due' ELSE 'what' END AS string_keys FROM part""",
)
def build_template(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    rf = F.when(
        even,
        F.concat(F.lit("Return exactly: amount=<amount>; name=<"), F.col("p_name"),
                 F.lit(" | none>; due=<date | null>")),
    ).otherwise("Return the rows, separated")
    gold = F.when(
        even, F.concat(F.lit('{"amount": 3.5, "name": "none", "due": "soon '), F.col("p_type"),
                       F.lit('"}')),
    ).otherwise(F.concat(F.lit('{"rows": ["'), F.col("p_name"), F.lit('"], "what": "x"}')))
    gold = F.try_variant_get(F.parse_json(gold), "$", "map<string,variant>")
    rows = part(spark, sf).withColumn("template", ty.build_template(rf, gold))
    return rows.select(
        "p_partkey", "template", F.array_join(ty.string_keys("template"), ",").alias("string_keys")
    )


@query(
    "T09_string_keys",
    """SELECT p_partkey, p_name || ',' || 'c' || p_size AS keys FROM part""",
)
def string_keys(spark, sf):
    t = F.concat(
        F.lit('{\n  "'), F.col("p_name"), F.lit('": <string>,\n  "b": <one of: string | x>,\n  "c'),
        F.col("p_size").cast("string"), F.lit('": <string | null>,\n  "d": <number>\n}'),
    )
    return part(spark, sf).select("p_partkey", F.array_join(ty.string_keys(t), ",").alias("keys"))


REPLY = {
    0: lambda n, s: F.concat(F.lit('{"name": "'), n, F.lit('", "size": '), s, F.lit("}")),
    1: lambda n, s: F.concat(F.lit('Sure: {"name": "'), n, F.lit('", "size": '), s, F.lit("} ok")),
    2: lambda n, s: F.concat(F.lit("I'm UNABLE to read "), n),
    3: lambda n, s: F.concat(F.lit("{broken "), n),
    4: lambda n, s: F.lit("  \n "),
}


def replies(spark, sf):
    n, s = F.col("p_name"), F.col("p_size").cast("string")
    return part(spark, sf).withColumn(
        "reply", pick(F.col("p_partkey") % 5, *[REPLY[i](n, s) for i in range(5)])
    )


@query(
    "T10_salvage_json",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_name END AS name,
         CASE WHEN p_partkey % 5 < 2 THEN CAST(p_size AS BIGINT) END AS size FROM part""",
)
def salvage_json(spark, sf):
    rows = replies(spark, sf).withColumn("v", js.salvage_json(F.col("reply")))
    return rows.select(
        "p_partkey", F.try_variant_get("v", "$.name", "string").alias("name"),
        F.try_variant_get("v", "$.size", "bigint").alias("size"),
    )


@query(
    "T11_response_class",
    "SELECT p_partkey, " + pick_sql(
        "p_partkey % 5", "'none'", "'none'", "'refusal'", "'parse_error'", "'empty'"
    ) + " AS class FROM part",
)
def response_class(spark, sf):
    return replies(spark, sf).select(
        "p_partkey", js.response_class(F.col("reply")).alias("class")
    )


@query(
    "T12_condition_hash",
    """SELECT p_partkey, 'vlm__' || p_brand || '__' || substr(sha256('{"no_image": false, "render": '
         || '{"dpi": ' || p_size || ', "engine": "' || p_type || '"}, "seed": null, "t": 0.0}'), 1, 12)
         AS key FROM part""",
)
def condition_hash(spark, sf):
    condition = F.concat(
        F.lit('{"t":0.0,"seed":null,  "render":{"engine":"'), F.col("p_type"), F.lit('","dpi":'),
        F.col("p_size").cast("string"), F.lit('},"no_image":false}'),
    )
    return part(spark, sf).select(
        "p_partkey", js.direct_key(F.col("p_brand"), condition).alias("key")
    )


@query(
    "T15_strip_code_fence",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(text, chr(32) || chr(9) || chr(10) || chr(13))
         WHEN 1 THEN text || chr(10) || '```' ELSE '```py' || chr(10) || 'x' END AS text
       FROM documents""",
)
def strip_code_fence(spark, sf):
    t = F.col("text")
    fenced = pick(
        F.col("doc_id") % 3, F.concat(F.lit("```Markdown \n"), t, F.lit("\n```\n")),
        F.concat(t, F.lit("\n```")), F.lit("```py\nx"),
    )
    return rel.table(spark, sf, "documents").select("doc_id", tx.strip_code_fence(fenced).alias("text"))


@query(
    "T16_safe_names",
    """SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS file_id,
         translate(url, '@./', '_-_') AS entry_name FROM pages""",
)
def safe_names(spark, sf):
    return rel.table(spark, sf, "pages").select(
        "page_id", tx.safe_file_id(F.col("url")).alias("file_id"),
        tx.safe_entry_name(F.col("url")).alias("entry_name"),
    )


WS = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{000B}]"
NORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate("
    "{0}, '‘’‚′“”„″', '''''''''\"\"\"\"'), '[‐‑‒–—―−]', '-', 'g'), "
    "'<br\\s*/?>|</?[a-z][^>]*>', ' ', 'gi'), '\\*\\*|__|`', '', 'g'), "
    f"'{WS}*([/\\-,:]){WS}*', '\\1', 'g'), '{WS}+', ' ', 'g'))"
)


@query(
    "C01_normalize_text",
    "SELECT page_id, md5(" + NORM.replace("{0}", "html") + ") AS norm FROM pages",
)
def normalize_text(spark, sf):
    return rel.table(spark, sf, "pages").select(
        "page_id", F.md5(tx.normalize_text(F.col("html"))).alias("norm")
    )


def variant_pairs(spark, sf):
    """Gold and answer as VARIANT for every line of every order, in seven spellings."""
    ln = F.col("l_linenumber")
    qty = F.col("l_quantity").cast("bigint").cast("string")
    price = F.format_number("l_extendedprice", 2)
    raw_price = F.col("l_extendedprice").cast("string")
    flag = F.col("l_returnflag")
    q = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    lit = F.lit
    gold = pick(
        ln - 1, qty, raw_price, F.when(flag == "R", "true").otherwise("false"),
        F.concat(lit('{"k": '), qty, lit(', "f": '), q(flag), lit("}")),
        F.concat(lit("["), q(flag), lit(", "), qty, lit("]")), q(flag, lit(" — "), qty), lit("null"),
    )
    answer = pick(
        ln - 1, q(lit("$"), qty, lit(".0")), q(price), F.when(flag == "N", "0").otherwise("true"),
        F.concat(lit('[{"f": '), q(lit("**"), flag, lit("**")), lit(', "k": '), q(qty, lit("%")),
                 lit("}]")),
        F.when(flag == "A", F.concat(lit("["), q(flag), lit("]")))
        .otherwise(F.concat(lit("["), q(flag), lit(", "), qty, lit("]"))),
        q(flag, lit("-"), qty), F.when(flag == "A", "null").otherwise('"x"'),
    )
    return rel.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice",
        F.parse_json(gold).alias("gold"), F.parse_json(answer).alias("answer"),
    )


@query(
    "C02_deep_equal",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE l_linenumber WHEN 3
         THEN l_returnflag = 'R' WHEN 5 THEN l_returnflag <> 'A' WHEN 7 THEN l_returnflag = 'A'
         ELSE true END AS equal FROM lineitem""",
)
def deep_equal(spark, sf):
    return variant_pairs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        cmp.compare(F.col("gold"), F.col("answer"), "deep").alias("equal"),
    )


# The edits are pure insertions or deletions of known length, a case change, or a letter rotation
# whose distance the Levenshtein bounds settle; the check works from those lengths.
@query(
    "C03_fuzzy_equal",
    """WITH t AS (SELECT p_partkey, concat_ws(' ', 'lot', p_name, p_brand, 'of type', p_type, 'size',
           CAST(p_size AS VARCHAR), 'kept in the upper store room') AS a, p_partkey % 12 AS cut
         FROM part), f AS (SELECT *, trim(regexp_replace(lower(a), '[^0-9a-z]+', ' ', 'g')) AS fa
         FROM t)
       SELECT p_partkey, CASE p_partkey % 4
         WHEN 0 THEN 100 * cut <= 8 * (2 * length(fa) + cut)
         WHEN 1 THEN 100 * (length(fa) - length(trim(substr(fa, CAST(cut + 1 AS INTEGER))))) <=
           8 * (length(fa) + length(trim(substr(fa, CAST(cut + 1 AS INTEGER)))))
         WHEN 2 THEN false ELSE true END AS equal FROM f""",
)
def fuzzy_equal(spark, sf):
    p = part(spark, sf)
    base = F.concat_ws(
        " ", F.lit("lot"), "p_name", "p_brand", F.lit("of type"), "p_type", F.lit("size"),
        F.col("p_size").cast("string"), F.lit("kept in the upper store room"),
    )
    cut = (F.col("p_partkey") % 12).cast("int")
    swapped = F.translate(base, "aeo", "eoa")
    variant = pick(
        F.col("p_partkey") % 4, F.concat(base, F.repeat(F.lit("x"), cut)),
        F.expr("substring(concat_ws(' ', 'lot', p_name, p_brand, 'of type', p_type, 'size', "
               "cast(p_size as string), 'kept in the upper store room'), cast(p_partkey % 12 as int)"
               " + 1)"),
        swapped, F.concat(F.upper(base), F.lit("!")),
    )
    rows = p.select("p_partkey", base.alias("a"), variant.alias("b"))
    va, vb = F.col("a").cast("variant"), F.col("b").cast("variant")
    return rows.select("p_partkey", cmp.compare(va, vb, "fuzzy").alias("equal"))
