"""Running sums, ranks and numbers over groups of any size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.session import written

#: Parts that a range of values is cut into by one pass of :func:`rank_values`.
PARTS = 512


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the keys are those of ``left``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def prefix_sums(df: DataFrame, by: list[str], order: list, values: dict[str, str]) -> DataFrame:
    """Running sums of ``values`` (output name -> column) per ``by`` in ``order``, no group in one task.

    All rows are sorted by range of (``by``, ``order``) once, with cut points that Spark takes from a
    sample of the data, so a large group fills many parts of like size. Each part is summed by
    itself; a part also adds the totals of its group's parts before it. ``order`` should tell rows
    of a group apart, as equal rows share a part.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = df.repartitionByRange(*by, *columns).withColumn("_part", F.spark_partition_id())
    # Written, as cut points could differ if the sort ran again.
    rows = written(cut, "prefix")
    upto = Window.unboundedPreceding
    inner = Window.partitionBy(*by, "_part").orderBy(*columns).rowsBetween(upto, 0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(upto, -1)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    totals = totals.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_p_{o}") for o in values]
    )
    sums = rows.withColumns({o: F.coalesce(F.sum(v).over(inner), F.lit(0)) for o, v in values.items()})
    out = join_same(sums, totals, [*by, "_part"]).withColumns({o: F.col(o) + F.col(f"_p_{o}") for o in values})
    return out.drop("_part", *[f"_p_{o}" for o in values])


def dense_numbers(df: DataFrame, order: list, name: str = "ord") -> DataFrame:
    """Number the rows 0, 1, 2, … in ``order``; each part is numbered by itself and moved up."""
    one = df.withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    return prefix_sums(one, ["_all"], order, {name: "_one"}).drop("_all", "_one").withColumn(
        name, (F.col(name) - 1).cast("bigint")
    )


def rank_values(
    df: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]],
    parts: int = PARTS,
) -> DataFrame:
    """The exact values at zero-based ranks of each group, one column per name of ``ranks``.

    A rank is a function of the group's number of values; NULL values are not counted, and a group
    without values has no row. Distributed selection: one pass counts the values of every searched
    range by parts between its ends, summed in the tasks first; each rank keeps the part that holds
    it, with the least and greatest value found there as the next range, until they are equal. The
    ends of a range are parts of their own, so every pass narrows it. The driver reads one count a
    pass; no task sees more of a group than its share of the input.
    """
    rows = written(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), "ranks")
    size = F.col("_n")
    needs = F.array(*[F.struct(F.lit(k).alias("name"), f(size).cast("bigint").alias("need")) for k, f in ranks.items()])
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(
        *by, "_lo", "_hi", F.explode(needs).alias("_k")
    ).select(*by, "_lo", "_hi", "_k.*")
    state = written(state, "ranks-state")
    settled = []
    while True:
        settled.append(state.where("_lo = _hi"))
        still = state.where("_lo < _hi")
        if not still.limit(1).count():
            break
        ranges = still.select(*by, "_lo", "_hi").distinct()
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        half = lambda c: c.cast("double") / 2  # noqa: E731  so that no difference overflows
        at = F.try_divide(half(v) - half(lo), half(hi) - half(lo))
        inner = F.least(F.greatest(F.coalesce(F.floor(at * parts), F.lit(0)), F.lit(0)), F.lit(parts - 1))
        part = F.when(v <= lo, -1).when(v >= hi, parts).otherwise(inner).cast("int").alias("_part")
        found = join_same(rows, ranges, by).where((v >= lo) & (v <= hi))
        keys = [*by, "_lo", "_hi"]
        counts = found.groupBy(*keys, part).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
        )
        upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part"))
        counts = counts.withColumn("_sum", upto)
        hit = (F.col("_sum") > F.col("need")) & (F.col("_sum") - F.col("_c") <= F.col("need"))
        state = written(
            join_same(still, counts, keys).where(hit).select(
                *by, F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), "name",
                (F.col("need") - F.col("_sum") + F.col("_c")).alias("need"),
            ),
            "ranks-state",
        )
    found = reduce(DataFrame.unionByName, settled)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("_lo"))).alias(k) for k in ranks])


#: Ranks of the two middle values; the median lies between them.
MIDDLE = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}


def medians(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group: the mean of the two middle values, as a double."""
    middle = (F.col("_low").cast("double") + F.col("_high").cast("double")) / 2
    return rank_values(df, by, value, MIDDLE).select(*by, middle.alias(name))
