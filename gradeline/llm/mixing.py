"""Mixing sources to target weights by hash-threshold histograms; no sort, no sampling noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.llm.common import WORD, written

BITS = 48
KEY = ["_none", "_source"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(ident: str = "doc_id", text: str = "text") -> Column:
    """48 bits of the MD5 of the id as text; of the text itself (null: empty) where the id is null."""
    digest = F.md5(F.coalesce(F.col(ident).cast("string"), F.col(text), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """Per source its size and target; one row per source.

    Sources in code point order, null last, take the weights in turn. Resharing what exceeds
    ``most`` times a source's size until nothing does ends where every source has
    min(cap, level * weight) for one level. In order of cap / weight, that is the level left by
    capping the sources before the first one that needs no cap, and the largest of those that fit.
    Windows here run over one row per source.
    """
    by = sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("_none", "_source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", *KEY).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "heavy": F.sum("weight").over(everything),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "spent": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("capped")) / (F.col("heavy") - F.col("spent"))
    by = by.withColumn("level", level)
    by = by.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return by.select(*KEY, "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame, levels: int = 4) -> DataFrame:
    """Per source the hash below which documents are taken to spend ``budget`` words.

    Each level sums words by source and a slice of the hash, finds the slice in which the budget
    runs out, and the next level sums only that slice. The last slice is taken when that ends
    nearer to the budget. A larger budget takes a superset of a smaller one's documents.
    """
    step = BITS // levels
    at = budgets.select(*KEY, F.col("budget").alias("_left"), F.lit(0).cast("long").alias("_path"))
    done = None
    for k in range(1, levels + 1):
        path = F.shiftright("hash", BITS - step * k)
        rows = sizes
        if k > 1:
            rows = sizes.withColumn("_path", F.shiftright("hash", BITS - step * (k - 1))).join(
                at.select(*KEY, "_path"), [*KEY, "_path"])
        sums = rows.withColumn("_slice", path).groupBy(*KEY, "_slice").agg(F.sum("size").alias("_n"))
        upto = Window.partitionBy(*KEY).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("_with", F.sum("_n").over(upto)).withColumn("_before", F.col("_with") - F.col("_n"))
        here = sums.join(at.select(*KEY, "_left"), KEY).where("_before <= _left AND _left < _with")
        if k == levels:
            nearer = F.col("_with") - F.col("_left") < F.col("_left") - F.col("_before")
            done = here.select(*KEY, (F.col("_slice") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
        at = here.select(*KEY, (F.col("_left") - F.col("_before")).alias("_left"), F.col("_slice").alias("_path"))
    whole = F.lit(1 << BITS).cast("long")
    return budgets.join(done, KEY, "left").select(*KEY, F.coalesce("threshold", whole).alias("threshold"))


def _planned(docs: DataFrame, sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``docs`` (with KEY, size and hash) joined to source_size and target, and copies."""
    goal = written(targets(sizes, weights, share, float(most)), "targets")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("base", base.cast("long"))
    budgets = goal.select(*KEY, (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"))
    goal = written(goal.join(thresholds(sizes, budgets), KEY), "plan")
    times = F.least(F.col("base") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0), F.lit(most))
    copies = F.when(F.col("size") > 0, times).otherwise(F.lit(1)).cast("int")
    return docs.join(goal, KEY).withColumn("copies", copies)


def sized(docs: DataFrame) -> list[Column]:
    return [
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"),
        word_count(F.col("text")).alias("size"), id_hash().alias("hash"),
    ]


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size, source_size, target, copies and taken.

    Every document is taken as often as its source's target covers the whole source, and once more
    when its hash lies below the source's threshold, never more than ``most`` times. Null texts
    have size 0; documents of size 0 are taken once and count nothing. Rows that repeat a doc_id
    share its hash and are taken together, and so do rows without one that repeat a text. Sizes are counted once and written, so the levels read
    a narrow table; a hot source only ever meets sums.
    """
    sizes = written(docs.select("doc_id", *sized(docs)), "sizes")
    plan = _planned(sizes, sizes, weights, share, most)
    return plan.select(
        "doc_id", F.when(~F.col("_none"), F.col("_source")).alias("source"), "size", "source_size", "target",
        "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def resample(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with its columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *sized(docs))
    sizes = written(docs.select(*sized(docs)), "sizes")
    plan = _planned(rows, sizes, weights, share, most).where("copies > 0")
    plan = plan.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"))
    return plan.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((r - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS heavy,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
      FROM w),
l AS (SELECT max((total - capped) / (heavy - spent)) FILTER ((total - capped) / (heavy - spent) <= ratio) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM o, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
c AS (SELECT d.doc_id, d.size, d.h, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
        CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * least(base + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own))
                                THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM c
"""
