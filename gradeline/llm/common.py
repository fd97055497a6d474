"""Shared pieces: words, Arrow batches, written tables, bucket blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.session import work_folder

#: A word is a run of anything but these six ASCII blanks; ``bytes.split()`` splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"

#: Bounds of what one Arrow batch brings into a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def arrow_bounds(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, so long texts cannot pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``: lineage ends, executors may be lost."""
    path = work_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(ident: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def apart(rows: DataFrame, ident: str, digest: Column, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` in which no id stands for two contents, and what the new ids stand for.

    Of rows that share an id but not the ``digest``, those of the smallest digest keep it and each
    other digest gets a number above all ids. The second table (key, real) is None where no id is
    shared so, and then ``rows`` come back as they are. Null ids stay null.
    """
    told = rows.withColumn("_d", digest)
    ends = told.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    shared = written(ends.where("_lo <> _hi").select(ident, "_lo"), f"{name}-shared")
    if shared.isEmpty():
        return rows, None
    top = rows.agg(F.max(ident)).first()[0]
    others = told.join(shared, ident).where("_d <> _lo").select(ident, "_d").distinct()
    others = written(others.withColumn("_key", F.lit(top + 1) + F.monotonically_increasing_id()), f"{name}-keys")
    out = told.join(others, [ident, "_d"], "left").withColumn(ident, F.coalesce("_key", ident))
    return out.select(*rows.columns), others.select(F.col("_key").alias("key"), F.col(ident).alias("real"))


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Whole groups of a partition sorted by ``keys``, gathered to about ``rows`` rows a time."""
    kept: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        have += batch.num_rows
        if have < rows:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks()
        starts = np.flatnonzero(group_starts(whole, keys))
        if len(starts) > 1:
            cut = int(starts[-1])
            yield whole.slice(0, cut)
            rest = whole.slice(cut)
            kept, have = rest.to_batches(), rest.num_rows
        else:
            kept = whole.to_batches()
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's ``keys`` (integers without nulls) differ from those of the row before."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        v = rows.column(key).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def matrix(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of equally long values as one numpy matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), width)


def block_jobs(rows: DataFrame, keys: list[str], ident: str, block: int) -> DataFrame:
    """Deal the members of each bucket to jobs of at most about ``2 * block`` rows.

    A bucket of up to ``block`` members is one job (lo = hi = 0). A larger one is cut by a hash of
    ``ident`` into blocks, and each pair of blocks is a job: every pair of members meets in exactly
    one job, and no task holds a bucket whole. Buckets of one member are left out, as they hold no
    pair. Adds ``lo``, ``hi`` and ``part`` (the member's own block).
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = rows.join(counts, keys).withColumn("_b", F.ceil(F.col("_n") / block).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(7), ident), "_b").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_o")
    return (
        dealt.select("*", other)
        .withColumn("lo", F.least("part", "_o"))
        .withColumn("hi", F.greatest("part", "_o"))
        .drop("_n", "_b", "_o")
    )


def pair_index(starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j inside each run of rows that begins at ``starts`` (runs kept small)."""
    sizes = np.diff(np.append(starts, total))
    end = np.repeat(starts + sizes, sizes)
    own = np.arange(total)
    reach = end - own - 1
    first = np.repeat(own, reach)
    step = np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach)
    return first, first + 1 + step


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each of ``n`` rows by the links ``a - b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    return root


def components(links: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node reachable.

    Alternates the large-star and small-star steps. Each step only takes minima by node (summed
    before the shuffle) and joins them back; a hub is a skewed join key, which Spark splits. Each
    round is a written table. Links reach no driver, only two numbers a round do.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    def mark(df: DataFrame):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = written(tidy(links), f"{name}-links")
    seen = mark(now)
    for _ in range(most):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tidy(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = tidy(small.unionByName(low.select("a", F.col("m").alias("b"))))
        now = written(small, f"{name}-round")
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()


def uint64(values: Iterable[int], n: int) -> np.ndarray:
    return np.fromiter(values, dtype=np.uint64, count=n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
