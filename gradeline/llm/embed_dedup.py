"""Near-duplicate vectors: rotated binary codes with correction factors decide what is recomputed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import apart, arrow_bounds, block_jobs, components, group_starts, local_roots, pair_index, pieces, written

#: Least bits of a bucket key, and number of keys then: a pair of cosine 0.9 shares none 6 times in
#: 100,000, a pair of cosine 0.95 once in ten million. Larger tables have more bits (see ``keying``).
KEY_BITS, TABLES = 14, 80
#: Unrelated vectors that a bucket holds on average, at most, and rotated components held at once.
CROWD, HELD = 4, 1 << 22
#: Standard errors of the estimate within which a pair is still recomputed.
SLACK = 5.0
BLOCK = 1500
#: Rows handled at once, and pairs recomputed at once.
ROWS, PAIRS = 6000, 100_000


def usable(vector: Column) -> Column:
    """True for vectors with components, all finite, and not all zero."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def keying(vectors: int) -> tuple[int, int]:
    """Bits of a key and number of keys for so many vectors.

    Bits grow with the logarithm of the number, so that a bucket holds ``CROWD`` unrelated vectors
    however many there are; keys grow with the bits, so that a pair of cosine 0.9 is missed as
    rarely as with ``TABLES`` keys of ``KEY_BITS`` bits.
    """
    bits = max(KEY_BITS, int(np.ceil(np.log2(max(vectors, 1) / CROWD))))
    same = 1 - np.arccos(0.9) / np.pi
    return bits, int(np.ceil(TABLES * np.log1p(-(same**KEY_BITS)) / np.log1p(-(same**bits)) - 1e-9))


@lru_cache(maxsize=8)
def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random rotations of ``dim`` dimensions, one above the other."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(count)])


def bucket_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) keys of sign bits of rotated unit vectors."""
    dim = x.shape[1]
    need = bits * tables
    stack = rotations(dim, -(-need // dim), 1)[:need].T
    weights = 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(x), tables), np.int64)
    step = max(1, HELD // need)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        out[at : at + step] = (part @ stack > 0).reshape(len(part), tables, bits) @ weights
    return out


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary codes (+1, -1) of unit vectors under one rotation, the rotated vectors, and the
    correction factors: the inner product of each vector with its own code."""
    turned = x @ rotations(x.shape[1], 1, 2).T
    signs = np.where(turned > 0, 1.0, -1.0)
    return signs.astype(np.float32), turned.astype(np.float32), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def unit_rows(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / norm[:, None], norm


def estimated(i: np.ndarray, j: np.ndarray, signs, turned, factor, least: float) -> np.ndarray:
    """Which pairs may reach ``least``: the code's unbiased estimate of the inner product, plus
    ``SLACK`` standard errors, which its correction factor tells."""
    dim = signs.shape[1]
    guess = np.einsum("ij,ij->i", signs[i], turned[j]) / (np.sqrt(dim) * factor[i])
    spread = np.sqrt(np.maximum(1 - factor[i] ** 2, 0)) / (factor[i] * np.sqrt(max(dim - 1, 1)))
    return guess + SLACK * spread >= least


def job_links(rows: pa.Table, least: float, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row numbers) of the jobs in ``rows``, each only in the first bucket it shares."""
    n = rows.num_rows
    u, _ = unit_rows(rows)
    signs, turned, factor = codes(u)
    dim = u.shape[1]
    part, lo, hi = (rows.column(c).to_numpy() for c in ("part", "lo", "hi"))
    table = rows.column("key").to_numpy() >> bits
    starts = np.flatnonzero(group_starts(rows, ["key", "lo", "hi"]))
    ends = np.append(starts[1:], n)
    out_i, out_j = [], []

    def exact(i, j):
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            near = np.einsum("ij,ij->i", u[a], u[b]) >= least
            out_i.append(a[near])
            out_j.append(b[near])

    small = ends - starts <= 64
    at = np.repeat(small, ends - starts)
    if at.any():
        keep = np.flatnonzero(at)
        sizes = (ends - starts)[small]
        i, j = pair_index(np.cumsum(sizes) - sizes, len(keep))
        i, j = keep[i], keep[j]
        across = (lo[i] == hi[i]) | (part[i] != part[j])
        i, j = i[across], j[across]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            may = estimated(a, b, signs, turned, factor, least)
            exact(a[may], b[may])
    for s, e in zip(starts[~small], ends[~small]):
        room = SLACK * np.sqrt(np.maximum(1 - factor[s:e] ** 2, 0)) / (factor[s:e] * np.sqrt(max(dim - 1, 1)))
        for k in range(s, e, 256):
            m = min(k + 256, e)
            guess = signs[k:m] @ turned[s:e].T / (np.sqrt(dim) * factor[k:m, None])
            a, b = np.nonzero(guess + room[k - s : m - s, None] >= least)
            a, b = a + k, b + s
            take = (a < b) & ((lo[a] == hi[a]) | (part[a] != part[b]))
            exact(a[take], b[take])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    if not len(i):
        return i, j
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys = bucket_keys(u[used], bits, tables)
    a, b = where[: len(i)], where[len(i) :]
    first = np.zeros(len(i), bool)
    for k in range(0, len(i), PAIRS // 4):
        same = keys[a[k : k + PAIRS // 4]] == keys[b[k : k + PAIRS // 4]]
        first[k : k + PAIRS // 4] = same.argmax(axis=1) == table[i[k : k + PAIRS // 4]]
    return i[first], j[first]


def near_duplicates(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """Per row of ``vectors``: its id, n_links, component_id and kept.

    Equal vectors form a class at once. Representatives are dealt to buckets by keys of
    sign bits (``keying``); large buckets are cut into block pairs. Inside a job, one vector's binary code and
    the other's rotated values give an unbiased estimate of the cosine; pairs whose upper bound
    reaches ``least`` are recomputed in double precision from the vectors themselves. A linked
    pair counts only in the first bucket it shares, so each task sends a number and one link per
    vector, never pairs.

    Null, zero or non-finite vectors, and vectors of another length, link with nothing (of unequal
    lengths only equally long ones are compared). n_links counts rows, so rows that repeat a vector
    count each other. Rows that repeat an id with another vector are vectors of their own.
    """
    spark = vectors.sparkSession
    arrow_bounds(spark)
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("x"))
    rows, names = apart(rows, "id", F.xxhash64("x"), "vector-ids")
    rows = rows.withColumn("ok", usable(F.col("x")))
    rows = rows.withColumns({"k1": F.when(F.col("ok"), F.xxhash64("x")), "k2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "x"))})
    good = rows.where("ok AND id IS NOT NULL")
    classes = written(good.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")), "classes")
    held = good.join(classes.select(F.col("rep").alias("id"), "k1", "k2", "w"), ["id", "k1", "k2"]).select("id", "w", "x")
    held = written(held.dropDuplicates(["id"]).withColumn("dim", F.size("x")), "vectors")
    bits, tables = keying(held.count())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column("id").to_numpy(), batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = pa.Table.from_batches([batch]).filter(pa.array(dims == dim))
                keys = bucket_keys(unit_rows(rows)[0], bits, tables) | (np.arange(tables) << bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[dims == dim], tables)), pa.array(np.full(keys.size, dim, np.int32)), pa.array(keys.ravel())],
                    ["id", "dim", "key"],
                )

    cells = held.select("id", "dim", "x").mapInArrow(deal, "id long, dim int, key long")
    jobs = block_jobs(cells, ["dim", "key"], "id", BLOCK)
    jobs = jobs.join(held.select("id", "w", "x"), "id").select("dim", "key", "lo", "hi", "part", "id", "w", "x")
    jobs = jobs.repartition("dim", "key", "lo", "hi").sortWithinPartitions("dim", "key", "lo", "hi", "id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, ["dim", "key", "lo", "hi"], ROWS):
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = whole.filter(pa.array(dims == dim)).combine_chunks()
                i, j = job_links(rows, least, bits, tables)
                ids, w = rows.column("id").to_numpy(), rows.column("w").to_numpy()
                n = np.bincount(i, w[j], len(ids)) + np.bincount(j, w[i], len(ids))
                seen = np.flatnonzero(n)
                root = local_roots(len(ids), i, j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[seen]), pa.array(n[seen].astype(np.int64)), pa.array(ids[root[seen]])], ["id", "n", "root"]
                )

    found = written(jobs.mapInArrow(link, "id long, n long, root long"), "links")
    totals = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "vectors")
    told = classes.join(totals.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("_c"))
    out = rows.join(told, ["k1", "k2"], "left")
    linked = F.col("ok") & F.col("id").isNotNull()
    out = out.withColumn("component_id", F.when(linked, F.col("_c")).otherwise(F.col("id")))
    out = out.withColumn("n_links", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long"))
    if names is not None:
        out = out.join(names, out["id"] == names["key"], "left").withColumn("id", F.coalesce("real", "id"))
        least_id = out.groupBy(F.col("component_id").alias("_of")).agg(F.min("id").alias("_least"))
        out = out.join(least_id, out["component_id"] == least_id["_of"], "left").withColumn("component_id", F.col("_least"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(ident), "n_links", "component_id", kept.alias("kept"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
      WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.vec_id, CAST((SELECT count(*) FROM e WHERE e.a = t.vec_id) AS BIGINT) AS n_links, k.c AS component_id, t.vec_id = k.c AS kept
FROM embeddings t JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) k ON k.a = t.vec_id
"""
