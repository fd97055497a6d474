"""Types of answer fields: hints from placeholders, templates, and coercion of raw gold text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeline.functions.compare import parse_number, value_kind, value_text
from gradeline.functions.text import squash, strip_space

# Vocabulary of placeholder words.
INTEGER_WORDS = ["digits", "digit", "year", "qty", "quantity", "count", "integer", "int"]
NUMBER_WORDS = [
    "amount", "money", "cost", "price", "fee", "balance", "total", "subtotal", "premium",
    "payment", "deposit", "percent", "percentage", "rate", "decimal", "float", "number",
]
DATE_WORDS = ["date", "mm/dd/yyyy", "mm-dd-yyyy", "yyyy-mm-dd", "yyyy/mm/dd"]
BOOLEAN_WORDS = ["boolean", "bool"]
TRUE_WORDS = ["y", "yes", "true", "checked", "1"]
FALSE_WORDS = ["n", "no", "false", "unchecked", "0"]
DATE_HINT = "date string YYYY-MM-DD"
# Shapes of a freeform response format.
DATE_SHAPE = r"(?i)m+[/\-. ]d+[/\-. ]y+|y{4}|month\s+y{2,4}|mm/yy"
NUMBER_SHAPE = r"(?i)\b(number|amount|dollar|currency|percentage|percent|numeric|decimal)\b"
DIGIT_MASK = r"x{2,}|#{2,}|sequence of digits|\(xxx\)"
# The pieces of a "Return exactly" response format.
FORMAT_PREFIX = r"^\s*Return exactly[^:]*:\s*"
FORMAT_PAIR = r"([^=<>;|]+)=<([^>]+)>"
TEMPLATE_ENTRY = r'"([^"]+)":\s*<([^>]+)>'

MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]


def tokens(c: Column) -> Column:
    """Non-blank alternatives of a ``a | b`` text."""
    return F.filter(F.transform(F.split(c, r"\|"), strip_space), lambda x: x != "")


def lower_all(arr: Column) -> Column:
    return F.transform(arr, F.lower)


def first_spellings(arr: Column) -> Column:
    """Drop later entries that differ only in case."""
    low = lower_all(arr)
    return F.filter(arr, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def base_type(hint: Column) -> Column:
    return strip_space(F.replace(hint, F.lit(" | null"), F.lit("")))


def placeholder_hint(inner: Column) -> Column:
    """Type hint of a placeholder such as ``amount``, ``yes | no | null`` or ``date``."""
    options = tokens(inner)
    kept = F.filter(options, lambda x: F.lower(x) != "null")
    low = lower_all(kept)
    pair = F.array_join(low, "|")
    word = F.try_element_at(low, F.lit(1))
    single = (
        F.when(word.isin(BOOLEAN_WORDS), "boolean")
        .when(word.isin(INTEGER_WORDS), "integer")
        .when(word.isin(NUMBER_WORDS), "number")
        .when(word.isin(DATE_WORDS), DATE_HINT)
        .otherwise("string")
    )
    many = F.when(pair.isin("true|false", "false|true"), "boolean").otherwise(
        F.concat(F.lit("one of: "), F.array_join(first_spellings(kept), " | "))
    )
    hint = F.when(F.size(kept) == 0, "string").when(F.size(kept) == 1, single).otherwise(many)
    nullable = F.exists(options, lambda x: F.lower(x) == "null")
    return F.when(nullable, F.concat(hint, F.lit(" | null"))).otherwise(hint)


def response_placeholder(response_format: Column) -> Column:
    """Placeholder body of a freeform response format."""
    s = strip_space(F.coalesce(response_format, F.lit("")))
    s = strip_space(F.regexp_replace(s, r"^\((.*)\)$", "$1"))
    inner = F.regexp_extract_all(s, F.lit(r"<([^<>]+)>"), 1)
    s = F.when(F.size(inner) > 0, F.array_join(inner, " | ")).otherwise(s)
    low = F.lower(s)
    slash = F.filter(F.transform(F.split(s, "/"), strip_space), lambda x: x != "")
    options = s.contains("/") & (F.length(s) <= 60) & ~s.rlike(DATE_SHAPE)
    return (
        F.when(s.contains("|"), s)
        .when(options & F.size(slash).between(2, 8), F.array_join(slash, " | "))
        .when(low.isin(*DATE_WORDS, "currency date") | low.rlike(DATE_SHAPE), "date")
        .when(low.rlike(DIGIT_MASK), "text")
        .when(low.isin("integer", "a two-digit number"), "integer")
        .when(low.rlike(NUMBER_SHAPE) | (low == "a number"), "number")
        .otherwise("text")
    )


def _day(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a calendar day, NULL when there is no such day."""
    text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def _month_number(name: Column) -> Column:
    name = F.lower(name)
    full = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    short = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name)
    return F.nullif(F.greatest(full, short), F.lit(0)).cast("string")


def iso_date(text: Column) -> Column:
    """ISO date of a text in any of the accepted spellings, else NULL.

    Month-first wins over day-first; two-digit years from 69 on are of the last century.
    """
    t = F.regexp_replace(strip_space(text), "[.,;:]+$", "")
    t = F.regexp_replace(t, r"\bSept\b", "Sep")

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))

    ymd = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"
    xxy = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"
    dmy = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"
    short = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{2})$"
    name_first = r"^([A-Za-z]+)\s+(\d{1,2})(?:,\s+|\s+)(\d{4})$"
    day_first = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    yy = part(short, 4)
    century = F.when(yy.cast("int") >= 69, "19").otherwise("20")
    guard = lambda need, value: F.when(need.isNotNull(), value)
    return F.coalesce(
        guard(part(ymd, 1), _day(part(ymd, 1), part(ymd, 3), part(ymd, 4))),
        guard(part(xxy, 1), _day(part(xxy, 4), part(xxy, 1), part(xxy, 3))),
        guard(part(dmy, 1), _day(part(dmy, 4), part(dmy, 3), part(dmy, 1))),
        guard(yy, _day(F.concat(century, yy), part(short, 1), part(short, 3))),
        guard(part(name_first, 1),
              _day(part(name_first, 3), _month_number(part(name_first, 1)), part(name_first, 2))),
        guard(part(day_first, 1),
              _day(part(day_first, 3), _month_number(part(day_first, 2)), part(day_first, 1))),
    )


def coerce_value(raw: Column, hint: Column) -> Column:
    """A raw gold text as VARIANT of the hinted type; SQL NULL stands for a null value."""
    text = strip_space(raw)
    low = F.lower(text)
    base = base_type(hint)
    enum = base.startswith("one of:")
    typed = base.isin("integer", "number", "boolean") | base.startswith("date")
    blank = (
        low.isin("null", "none", "", "—", "–")
        | (typed & (low == "-"))
        | (low.isin("n/a", "na") & ~enum & ~hint.contains("string"))
    )
    bare = F.regexp_replace(text, r"(?U)[,$\s]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\++", ""), "%+$", "")
    whole = F.when(bare.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(bare, F.lit("_"), F.lit("")))
    as_whole = whole.try_cast("decimal(38,0)").cast("variant")
    as_double = parse_number(bare).cast("variant")
    choices = tokens(F.regexp_replace(base, "^one of:", ""))
    choice = F.try_element_at(F.filter(choices, lambda x: F.lower(x) == low), F.lit(1))
    plain = text.cast("variant")
    return (
        F.when(raw.isNull() | blank, F.lit(None).cast("variant"))
        .when(base == "integer", F.coalesce(as_whole, as_double, plain))
        .when(base == "number",
              F.coalesce(F.when(bare.contains("."), as_double).otherwise(as_whole), plain))
        .when(base.startswith("date"), F.coalesce(iso_date(text), text).cast("variant"))
        .when((base == "boolean") & low.isin(TRUE_WORDS), F.lit(True).cast("variant"))
        .when((base == "boolean") & low.isin(FALSE_WORDS), F.lit(False).cast("variant"))
        .when(base == "boolean", plain)
        .when(enum, F.coalesce(choice, text).cast("variant"))
        .otherwise(squash(text).cast("variant"))
    )


def widen_hint(hint: Column, kind: Column, text: Column) -> Column:
    """The hint, loosened where a gold value (leaf form) does not fit it."""
    base = base_type(hint)
    is_text = kind == "str"
    tail = F.when(hint.contains("null"), " | null").otherwise("")
    number_text = base.isin("integer", "number") & is_text & (strip_space(text) != "")
    choices = lower_all(tokens(F.regexp_replace(base, "^one of:", "")))
    loose = F.concat(F.lit("string"), tail)
    return (
        F.when(number_text & iso_date(text).isNotNull(), F.concat(F.lit(DATE_HINT), tail))
        .when(number_text, loose)
        .when(base.startswith("date") & is_text & ~text.rlike(r"^\d{4}-\d{2}-\d{2}$"), loose)
        .when(base.startswith("one of:") & is_text & ~F.array_contains(choices, F.lower(text)),
              loose)
        .otherwise(hint)
    )


def widen_gold(hint: Column, kind: Column, text: Column) -> Column:
    """The gold text after widening: a date under a number hint is rewritten to ISO form."""
    number = base_type(hint).isin("integer", "number") & (kind == "str")
    return F.when(number, F.coalesce(iso_date(text), text)).otherwise(text)


def quoted(key: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('"'))


def render_template(fields: Column) -> Column:
    """Template text of ``array<struct<key,hint>>``; keys that start with ``__`` stay hidden."""
    shown = F.filter(fields, lambda f: ~f["key"].startswith("__"))
    lines = F.transform(
        shown,
        lambda f: F.concat(F.lit("  "), quoted(f["key"]), F.lit(": <"), f["hint"], F.lit(">")),
    )
    body = F.when(F.size(shown) > 0, F.concat(F.array_join(lines, ",\n"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("{\n"), body, F.lit("}"))


def build_template(response_format: Column, gold: Column) -> Column:
    """Typed template of a ``Return exactly: k=<tok>; ...`` format, widened by gold values.

    ``gold`` is ``map<string,variant>``. Without any pair the shape comes from the gold: lists are
    lists of strings, everything else is a string.
    """
    body = F.regexp_replace(F.coalesce(response_format, F.lit("")), FORMAT_PREFIX, "")
    keys = F.transform(F.regexp_extract_all(body, F.lit(FORMAT_PAIR), 1), strip_space)
    marks = F.regexp_extract_all(body, F.lit(FORMAT_PAIR), 2)
    gold = F.coalesce(gold, F.create_map().cast("map<string,variant>"))

    def field(pair: Column) -> Column:
        value = F.try_element_at(gold, pair["k"])
        hint = placeholder_hint(pair["t"])
        kind = value_kind(value)
        return F.struct(
            pair["k"].alias("key"),
            F.when(kind == "str", widen_hint(hint, kind, value_text(value))).otherwise(hint)
            .alias("hint"),
        )

    # A key named twice keeps its first place and its last type.
    pairs = F.arrays_zip(keys.alias("k"), marks.alias("t"))
    firsts = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    last = F.map_from_entries(
        F.transform(
            F.filter(
                pairs,
                lambda p, i: F.size(keys)
                - F.array_position(F.reverse(keys), p["k"]) == i,
            ),
            lambda p: F.struct(p["k"], p["t"]),
        )
    )
    typed = F.transform(
        F.transform(
            firsts, lambda p: F.struct(p["k"].alias("k"), F.element_at(last, p["k"]).alias("t"))
        ),
        field,
    )
    shape = F.transform(
        F.map_entries(gold),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(value_kind(e["value"]) == "list", "list of strings").otherwise("string")
            .alias("hint"),
        ),
    )
    lone = F.array(F.struct(F.lit("answer").alias("key"), F.lit("string").alias("hint")))
    fields = F.when(F.size(pairs) > 0, typed).when(F.size(shape) > 0, shape).otherwise(lone)
    return render_template(fields)


def string_keys(template: Column) -> Column:
    """Keys whose type is exactly ``string`` once nullability is set aside."""
    keys = F.regexp_extract_all(template, F.lit(TEMPLATE_ENTRY), 1)
    hints = F.regexp_extract_all(template, F.lit(TEMPLATE_ENTRY), 2)
    pairs = F.arrays_zip(keys.alias("k"), hints.alias("h"))
    plain = F.filter(
        pairs,
        lambda p: strip_space(F.replace(p["h"], F.lit("| null"), F.lit(""))) == "string",
    )
    return F.array_distinct(F.transform(plain, lambda p: p["k"]))
