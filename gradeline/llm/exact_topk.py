"""Exact top-k by distributed histogram selection over integer inner products.

Every query is scored against every row in each pass, in blocks. A pass counts the scores of each
query by parts of a range, from the top; the part that holds the k-th value is the next pass's range,
until few enough scores lie at or above it or it is a single value. A last pass keeps the rows at or
above that bound, which are ranked by score and then by vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.llm.common import written

#: A range is cut into 2**PART_BITS parts.
PART_BITS = 9
PARTS = 1 << PART_BITS
#: A bound is close enough once at most this many times k scores lie at or above it.
ENOUGH = 4
#: Rows of a block, queries of a block, and queries scored at once.
ROW_BLOCK, QUERY_BLOCK, AT_ONCE = 2048, 4096, 128
#: Most copies of a block of queries; rows are dealt over them.
COPIES = 1024
#: Whole numbers below this are exact in doubles; scores stay below the other.
EXACT, LARGEST = 1 << 53, 1 << 61
#: Stands for a null vec_id, which comes after all others.
NO_ID = (1 << 63) - 1
#: Below every score: not a candidate.
NO_SCORE = -(1 << 62)


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component; null for a vector that is null or holds a null or non-finite one."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~broken, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024.0)))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles while all partial sums are exact in them."""
    reach = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * queries.shape[1]
    if reach < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


class Asked:
    """A block of queries as arrays, with the range that each is searched in."""

    def __init__(self, row: pa.RecordBatch, width: int):
        self.block = row.column("block")[0].as_py()
        self.q, self.ids, self.low, self.shift, self.need = (
            row.column(c).flatten().to_numpy() for c in ("qs", "ids", "lows", "shifts", "needs")
        )
        self.numbers = row.column("numbers").flatten().to_numpy().reshape(len(self.q), width)


def scores(asked: Asked, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of some queries at a time against a block of rows; rows with the query's id have none."""
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids, asked.ids, "left", sorter=order)
    last = np.searchsorted(ids, asked.ids, "right", sorter=order)
    for start in range(0, len(asked.q), AT_ONCE):
        part = slice(start, min(start + AT_ONCE, len(asked.q)))
        found = products(asked.numbers[part], rows)
        for i in np.flatnonzero(last[part] > first[part]):
            found[i, order[first[start + i] : last[start + i]]] = NO_SCORE
        yield part, found


def _jobs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[Asked, np.ndarray, np.ndarray]]:
    """(queries, ids, rows) of each joined row; a block of queries is read once while it repeats."""
    asked = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if asked is None or row.column("block")[0].as_py() != asked.block:
                asked = Asked(row, width)
            ids = row.column("row_ids").flatten().to_numpy()
            yield asked, ids, row.column("row_numbers").flatten().to_numpy().reshape(len(ids), width)


def counted(jobs: DataFrame, width: int) -> DataFrame:
    """(q, part, n): each task's scores by part of the range, from the top down to the part in which
    the task alone has all that are needed: the value sought lies there or higher."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def top(asked: Asked, counts: np.ndarray) -> pa.RecordBatch:
            down = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
            i, part = np.nonzero((counts > 0) & (down - counts < asked.need[:, None]))
            return pa.RecordBatch.from_arrays([pa.array(asked.q[i]), pa.array(part), pa.array(counts[i, part])], names=["q", "part", "n"])

        last, counts = None, None
        for asked, ids, rows in _jobs(batches, width):
            if asked is not last:
                if last is not None:
                    yield top(last, counts)
                last, counts = asked, np.zeros((len(asked.q), PARTS), dtype=np.int64)
            for some, found in scores(asked, ids, rows):
                part = (found - asked.low[some, None]) >> asked.shift[some, None]
                i, j = np.nonzero((part >= 0) & (part < PARTS))
                size = found.shape[0] * PARTS
                counts[some] += np.bincount(i * PARTS + part[i, j], minlength=size).reshape(-1, PARTS)
        if last is not None:
            yield top(last, counts)

    return jobs.mapInArrow(count, "q long, part long, n long")


def kept(jobs: DataFrame, width: int, k: int) -> DataFrame:
    """(q, vec_id, score) at or above each query's bound; of one block of rows the best k at most."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, ids, rows in _jobs(batches, width):
            for some, found in scores(asked, ids, rows):
                i, j = np.nonzero((found >= asked.low[some, None]) & (found != NO_SCORE))
                value, ident = found[i, j], ids[j]
                order = np.lexsort((ident, -value, i))
                i, value, ident = i[order], value[order], ident[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                good = place < k
                if good.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked.q[some][i[good]]), pa.array(ident[good]), pa.array(value[good])], names=["q", "vec_id", "score"]
                    )

    return jobs.mapInArrow(keep, "q long, vec_id long, score long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` highest scores, ties to the smaller vec_id.

    A vector's components become floor(1024 * x); a score is the integer inner product. Vectors that
    are null or hold null or non-finite components take no part; a shorter one is filled up with zeros,
    an empty one scores 0. Candidates are all rows but those with the query's own id; with fewer than
    ``k``, all are returned. A null id is no query and the last among ties. Each row that is a query is
    one, so repeated query rows repeat their results. Other columns are not looked at. Scores beyond
    2**61 raise an error. The driver reads five numbers and, per pass, the count of open queries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.coalesce(F.col(ident).cast("long"), F.lit(NO_ID)).alias("id"), scaled(F.col(vector)).alias("numbers"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("at"),
    ).where("numbers IS NOT NULL")
    rows = written(rows.withColumn("norm", F.sqrt(F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x.cast("double") * x))), "topk-rows")
    count, asking, width, longest, loudest = rows.agg(
        F.count(F.lit(1)), F.count_if("is_query"), F.max(F.size("numbers")), F.max("norm"), F.max(F.when(F.col("is_query"), F.col("norm")))
    ).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not asking:
        return spark.createDataFrame([], result)
    if longest * loudest >= LARGEST:
        raise ValueError("inner products do not fit in a long")

    def blocks(size: int, n: int) -> Column:
        return F.pmod(F.xxhash64("at"), F.lit(max(1, -(-n // size))))

    filled = F.concat("numbers", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("numbers")))
    held = rows.select(blocks(ROW_BLOCK, count).alias("at"), F.struct("id", filled.alias("numbers")).alias("s")).groupBy("at").agg(F.collect_list("s").alias("s"))
    copies = min(COPIES, -(-count // ROW_BLOCK))
    held = written(held.select(
        F.pmod(F.xxhash64("at"), F.lit(copies)).alias("copy"), F.col("s.id").alias("row_ids"), F.flatten("s.numbers").alias("row_numbers")
    ), "topk-blocks")
    # The range of a query's scores: its norm times the longest one, by the Cauchy-Schwarz inequality.
    reach = F.ceil(F.col("norm") * longest * (1 + 1e-9)) + 1
    queries = written(rows.where("is_query").select(
        F.col("at").alias("q"), "id", filled.alias("numbers"), blocks(QUERY_BLOCK, asking).alias("block"),
        (-reach).alias("low"), F.greatest(F.lit(0), F.ceil(F.log2(2.0 * reach + 2)) - PART_BITS).cast("long").alias("shift"),
        F.lit(k).cast("long").alias("need"),
    ), "topk-queries")
    vectors_of = queries.select("q", "id", "numbers", "block")

    def jobs(state: DataFrame) -> DataFrame:
        asked = vectors_of.join(state, "q").groupBy("block").agg(
            F.collect_list(F.struct("q", "id", "low", "shift", "need", "numbers")).alias("s")
        ).select(
            "block", F.col("s.q").alias("qs"), F.col("s.id").alias("ids"), F.col("s.low").alias("lows"), F.col("s.shift").alias("shifts"),
            F.col("s.need").alias("needs"), F.flatten("s.numbers").alias("numbers"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"),
        )
        return asked.repartition(copies, "copy").join(held.repartition(copies, "copy"), "copy")

    state = queries.select("q", "low", "shift", "need")
    bounds = []
    while True:
        part = counted(jobs(state), width).groupBy("q", "part").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("part")))
        part = part.select("*", above.alias("sum")).join(state, "q").where("sum >= need AND sum - n < need")
        # Found: the part that holds the k-th value. Queries with fewer candidates have none and keep all.
        found = part.select(
            "q", F.expr("low + shiftleft(part, cast(shift AS int))").alias("low"), F.greatest(F.col("shift") - PART_BITS, F.lit(0)).alias("shift"),
            (F.col("need") - F.col("sum") + F.col("n")).alias("need"),
            ((F.col("shift") > 0) & (F.col("sum") - F.col("need") + k > ENOUGH * k)).alias("open"),
        )
        step = written(state.select("q", F.col("low").alias("_low")).join(found, "q", "left").select(
            "q", F.coalesce("low", "_low").alias("low"), F.coalesce("shift", F.lit(0)).alias("shift"), F.coalesce("need", F.lit(k)).alias("need"),
            F.coalesce("open", F.lit(False)).alias("open"),
        ), "topk-bounds")
        bounds.append(step.where("NOT open").drop("open"))
        state = step.where("open").drop("open")
        if not state.limit(1).count():
            break
    settled = bounds[0]
    for more in bounds[1:]:
        settled = settled.unionByName(more)
    near = kept(jobs(settled), width, k)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return near.join(vectors_of.select("q", F.col("id").alias("query_id")), "q").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
