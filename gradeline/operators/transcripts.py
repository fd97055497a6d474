"""Transcript text analytics. A transcript is one row ``parser, doc, text``; whole texts are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.prefix import join_same, medians
from gradeline.functions.ratio import count_if, share
from gradeline.operators.metrics import CHECKBOX_TAGS, has_any_tag

# Glyph sets of the three analyses.
RECALL_GLYPH = r"(?i)[☒☐☑]|\[x\]|\[ \]"
CENSUS_GLYPHS = "☐☑☒□▢■✓✔"
MARKED = "☑☒■✓✔●√✕×▪"
UNMARKED = "☐□▢○"
PAGE_TITLE = "## Page "
ANNOTATION_TITLE = "\n\n## Checkbox states (document_annotation)\n\n"


def word_runs(text: Column) -> Column:
    """Maximal runs of word characters in lower case; an underscore stays inside its run."""
    return F.split(F.lower(text), r"(?U)\W+")


def field_tokens(bank: DataFrame) -> DataFrame:
    """Per checkbox document: distinct key tokens of three letters or more of its boolean golds."""
    rows = bank.where(has_any_tag(F.col("capabilities"), CHECKBOX_TAGS)).select(
        "doc", F.explode("fields").alias("f")
    ).where(F.col("f.gold_kind") == "bool")
    words = F.filter(
        F.regexp_extract_all("f.key", F.lit("[a-zA-Z0-9]+"), 0), lambda w: F.length(w) >= 3
    )
    return rows.select("doc", F.explode_outer(words).alias("w")).groupBy("doc").agg(
        F.collect_set(F.lower("w")).alias("tokens")
    )


def transcript_recall(bank: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Share of checkbox documents whose transcript has a glyph and a whole-word field token.

    Each document's text meets its own token set in place. A document without transcript is not
    recalled; a system without any transcript has no row.
    """
    tokens = field_tokens(bank)
    n_docs = tokens.select(F.count("*")).scalar()
    hit = F.col("text").rlike(RECALL_GLYPH) & F.arrays_overlap(word_runs(F.col("text")), "tokens")
    recalled = transcripts.join(tokens, "doc").where(hit).groupBy("parser").agg(
        F.count("*").alias("recalled")
    )
    legs = transcripts.select("parser").distinct()
    return legs.join(recalled, "parser", "left").select(
        "parser", F.coalesce("recalled", F.lit(0)).alias("recalled"), n_docs.alias("n_docs"),
        F.when(n_docs > 0, F.coalesce("recalled", F.lit(0)) / n_docs).alias("recall"),
    )


def glyph_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{CENSUS_GLYPHS}]"))


def glyph_census(transcripts: DataFrame) -> DataFrame:
    """Per leg: documents with a glyph, glyphs, and the share right before a word."""
    led = F.regexp_count("text", F.lit(rf"(?U)[{CENSUS_GLYPHS}][ \t]*\w"))
    rows = transcripts.select("parser", glyph_count(F.col("text")).alias("g"), led.alias("led"))
    return rows.groupBy("parser").agg(
        F.count("*").alias("n_docs"), count_if(F.col("g") > 0).alias("docs_with_glyph"),
        F.sum("g").cast("bigint").alias("glyphs"),
        share(F.sum("led"), F.sum("g")).alias("before_label"),
    )


def retention_band(ratio: Column) -> Column:
    return (
        F.when(ratio == 0, "0").when(ratio < 0.5, "1-50").when(ratio < 0.9, "50-90")
        .when(ratio <= 1.1, "90-110").otherwise(">110")
    )


def glyph_retention(transcripts: DataFrame, reference: str) -> DataFrame:
    """Glyphs per document against a reference leg; documents where it has none drop out."""
    g = transcripts.select("parser", "doc", glyph_count(F.col("text")).alias("g"))
    base = g.where((F.col("parser") == reference) & (F.col("g") > 0)).select(
        "doc", F.col("g").alias("base")
    )
    ratio = F.col("g") / F.col("base")
    return g.where(F.col("parser") != reference).join(base, "doc").select(
        "parser", "doc", "g", "base", ratio.alias("ratio"), retention_band(ratio).alias("band")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; columns that later steps refer to could be computed
    again for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(values: Column) -> Column:
    """Lengths of the runs of equal neighbours, as structs of place (from 0) and n."""
    starts = F.filter(
        F.transform(values, lambda _, i: i), lambda i: (i == 0) | ~F.get(values, i).eqNullSafe(F.get(values, i - 1))
    )
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(values)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("place"), (b - a).alias("n")))


def repeated_phrases(
    transcripts: DataFrame, *, words: int = 4, times: int = 20
) -> DataFrame:
    """Documents where one phrase of ``words`` words occurs at least ``times`` times.

    All within the row, whole texts: the phrases' hashes are sorted and runs of ``times`` found; only
    phrases with such a hash are compared as texts. A phrase that occurs ``times`` times repeats its
    first word as often, so a document with fewer repeated words is settled before that.
    """
    w = transcripts.select("parser", "doc", F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda x: x != "").alias("_w"))
    loose = w.where(F.size("_w") - F.size(F.array_distinct("_w")) >= times - 1).where(F.size("_w") >= words)
    places = F.sequence(F.lit(0), F.size("_w") - words)
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(words)]))

    def often(s: Column) -> Column:
        return F.transform(F.filter(_runs(s), lambda r: r["n"] >= times), lambda r: F.get(s, r["place"]))

    def phrases(h: Column, common: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(common, x), i)), lambda i: i.isNotNull())
        return F.sort_array(F.transform(at, lambda i: F.array_join(F.slice("_w", i + 1, words), " ")))

    def counts(p: Column) -> Column:
        return F.filter(F.transform(_runs(p), lambda r: r["n"]), lambda n: n >= times)

    found = _let(hashed, lambda h: _let(F.sort_array(h), lambda s: _let(often(s), lambda common: _let(
        phrases(h, common), lambda p: _let(counts(p), lambda n: F.struct(
            F.array_max(n).cast("bigint").alias("most"), F.size(n).cast("bigint").alias("n_phrases")))))))
    return loose.select("parser", "doc", F.inline(F.filter(F.array(found), lambda r: r["n_phrases"] > 0)))


def labelled_glyphs(transcripts: DataFrame) -> DataFrame:
    """(parser, doc, label, marked): the word right after each glyph on its line."""
    marks = F.transform(
        F.regexp_extract_all("text", F.lit(rf"(?U)[{MARKED}{UNMARKED}][ \t]*\w+"), 0),
        lambda m: F.struct(
            F.lower(F.regexp_extract(m, r"(?U)(\w+)$", 1)).alias("label"),
            F.substring(m, 1, 1).isin(list(MARKED)).alias("marked"),
        ),
    )
    return transcripts.select("parser", "doc", F.inline(marks)).groupBy(
        "parser", "doc", "label"
    ).agg(F.bool_or("marked").alias("any_marked"), F.bool_and("marked").alias("all_marked"))


def loss_attribution(lost: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Why a transcriber lost a field that the direct leg got right.

    ``lost`` holds parser, qid, key, doc, label and gold_true. Without any glyph the mark was lost
    in transcription; beside its label with the right polarity the extractor lost it; with the
    wrong one the transcript is wrong; elsewhere only, it was serialised away from its label.
    """
    has = transcripts.select(
        "parser", "doc", F.col("text").rlike(f"[{MARKED}{UNMARKED}]").alias("any_glyph")
    )
    rows = lost.withColumn("label", F.lower("label")).join(has, ["parser", "doc"], "left").join(
        labelled_glyphs(transcripts), ["parser", "doc", "label"], "left"
    )
    agrees = F.when(F.col("gold_true"), F.col("any_marked")).otherwise(~F.col("all_marked"))
    cause = (
        F.when(~F.coalesce("any_glyph", F.lit(False)), "transcription loss")
        .when(F.col("any_marked").isNull(), "serialization loss")
        .when(agrees, "extraction loss").otherwise("transcription error")
    )
    return rows.withColumn("cause", cause)


def ablation_arms(transcripts: DataFrame, decoy: str, seed: int = 0) -> DataFrame:
    """The four arms of a memorisation probe: real, line-shuffled, empty and decoy text.

    Lines are put in hash order of (seed, document, position) inside their row.
    """
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), "doc", i.cast("string"))).alias("h"),
            line.alias("line"),
        ),
    )
    shuffled = F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n")
    arms = F.array(
        F.struct(F.lit("real").alias("arm"), F.col("text").alias("body")),
        F.struct(F.lit("shuffled").alias("arm"), shuffled.alias("body")),
        F.struct(F.lit("empty").alias("arm"), F.lit("").alias("body")),
        F.struct(F.lit("decoy").alias("arm"), F.lit(decoy).alias("body")),
    )
    return transcripts.select("parser", "doc", F.inline(arms))


def arm_rates(scored_arms: DataFrame) -> DataFrame:
    """Correct share per arm, and the ceiling of the arms that show nothing to read."""
    rates = scored_arms.groupBy("parser", "arm").agg(
        count_if(F.coalesce("match", F.lit(False))).alias("correct"),
        share(count_if(F.coalesce("match", F.lit(False))), F.count("*")).alias("rate"),
    )
    blind = rates.where(F.col("arm").isin("empty", "decoy")).groupBy("parser").agg(
        F.max("rate").alias("blind_ceiling")
    )
    return rates.join(blind, "parser", "left")


def length_profile(transcripts: DataFrame) -> DataFrame:
    """Documents per leg with their least, median and greatest length."""
    sizes = transcripts.select("parser", F.length("text").alias("n"))
    base = sizes.groupBy("parser").agg(F.count("*").alias("n_docs"), F.min("n").alias("min"), F.max("n").alias("max"))
    return join_same(base, medians(sizes, ["parser"], "n"), ["parser"], "left")


def assemble_pages(pages: DataFrame, separator: str | None = None) -> DataFrame:
    """One transcript per document from its pages, by page number.

    Pages carry a heading, or are parted by ``separator`` (such as ``---``) instead.
    """
    if separator is None:
        number = F.concat(F.lit(PAGE_TITLE), F.col("page").cast("string"), F.lit("\n\n"))
        body = F.regexp_replace(F.concat(number, "markdown"), r"(?U)\s+$", "")
        glue = "\n\n"
    else:
        body, glue = F.col("markdown"), f"\n\n{separator}\n\n"
    ordered = F.array_sort(F.collect_list(F.struct("page", body.alias("b"))))
    return pages.groupBy("doc").agg(
        F.array_join(F.transform(ordered, lambda x: x["b"]), glue).alias("text")
    )


def append_annotation(text: Column, annotation: Column) -> Column:
    """Text with the annotation's checkbox lines behind it; unreadable JSON adds nothing."""
    items = F.from_json(
        annotation, "struct<checkbox_items:array<struct<label:string,checked:boolean>>>"
    )["checkbox_items"]
    lines = F.transform(
        items,
        lambda it: F.rtrim(
            F.concat(
                F.when(F.coalesce(it["checked"], F.lit(False)), "☑ ").otherwise("☐ "),
                F.coalesce(it["label"], F.lit("")),
            )
        ),
    )
    extra = F.when(
        F.coalesce(F.size(lines), F.lit(0)) > 0,
        F.concat(F.lit(ANNOTATION_TITLE), F.array_join(lines, "\n")),
    )
    return F.concat(text, F.coalesce(extra, F.lit("")))
