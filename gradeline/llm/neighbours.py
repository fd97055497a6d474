"""Nearest neighbours by inner product: multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeline.llm.common import apart, arrow_bounds, group_starts, pieces, written
from gradeline.llm.embed_dedup import rotations, usable

#: A code has so many bits, cut into substrings of 16 that are each indexed.
BITS, SUB = 256, 16
TABLES = BITS // SUB
#: Vectors and queries of one job.
ROW_BLOCK, QUERY_BLOCK = 4096, 512


@dataclass
class CodeModel:
    """Learned rotations, the norm that all vectors are lifted to, and the Hamming radius."""

    turn: np.ndarray  # (BITS, dim + 1)
    top: float
    radius: int

    def codes(self, x: np.ndarray, lift: bool) -> np.ndarray:
        """(rows, TABLES) substrings. Vectors are lifted to one norm by an extra dimension, which
        turns the largest inner product into the smallest angle; queries have 0 there."""
        extra = np.sqrt(np.maximum(self.top**2 - np.einsum("ij,ij->i", x, x), 0)) if lift else np.zeros(len(x))
        bits = np.column_stack([x, extra]) @ self.turn.T > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn(sample: np.ndarray, top: float, k: int, hit: float = 0.98, rounds: int = 25) -> CodeModel:
    """Rotations that bring the lifted sample nearest to its signs, and the radius that holds the
    share ``hit`` of the sample's own ``k`` nearest neighbours."""
    lifted = np.column_stack([sample, np.sqrt(np.maximum(top**2 - (sample**2).sum(axis=1), 0))]) / max(top, 1e-30)
    dim = lifted.shape[1]
    turns = []
    for group in range(-(-BITS // dim)):
        r = rotations(dim, 1, 100 + group)
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(lifted @ r.T > 0, 1.0, -1.0).T @ lifted)
            r = u @ vt
        turns.append(r)
    model = CodeModel(np.concatenate(turns)[:BITS], top, BITS)
    asked = sample[:: max(1, len(sample) // 300)]
    near = np.argsort(-(asked @ sample.T), axis=1)[:, : k + 1]
    away = np.bitwise_count(model.codes(asked, False)[:, None, :] ^ model.codes(sample, True)[near]).sum(axis=2)
    model.radius = int(np.quantile(away, hit))
    return model


def probe(codes: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (query, row) pairs within ``radius`` bits, found through the substring tables.

    Codes within the radius have one of the ``TABLES`` substrings within radius // TABLES bits. Per
    table the occupied buckets that near a query's substring are looked up (by flipping its bits,
    or by comparing with the occupied buckets where those are fewer), and the rows found in any
    table are checked on their whole code.
    """
    reach = radius // TABLES
    masks = np.arange(1 << SUB, dtype=np.uint16)
    masks = masks[np.bitwise_count(masks) <= reach]
    seen = np.zeros((len(asked), len(codes)), bool)
    for t in range(TABLES):
        buckets, where = np.unique(codes[:, t], return_inverse=True)
        if len(masks) < len(buckets):
            wanted = asked[:, t, None] ^ masks
            at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
            hit = np.zeros((len(asked), len(buckets)), bool)
            q, m = np.nonzero(buckets[at] == wanted)
            hit[q, at[q, m]] = True
        else:
            hit = np.bitwise_count(asked[:, t, None] ^ buckets) <= reach
        seen |= hit[:, where]
    q, row = np.nonzero(seen)
    away = np.zeros(len(q), np.uint16)
    wide_codes, wide_asked = codes.view(np.uint64), asked.view(np.uint64)
    for w in range(wide_codes.shape[1]):
        away += np.bitwise_count(wide_asked[q, w] ^ wide_codes[row, w])
    near = away <= radius
    return q[near], row[near]


def _matrix(rows: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype).reshape(rows.num_rows, -1)


def _search(queries: DataFrame, rows: DataFrame, model: CodeModel, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's ``k`` best rows of each block, by jobs of blocks."""
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = -(-n_rows // ROW_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1

    def blocks(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    hashed = F.xxhash64(F.lit(5), "id")
    one = rows.withColumn("rb", F.pmod(hashed, F.lit(row_blocks)).cast("int")).withColumn("qb", blocks(query_blocks))
    two = queries.withColumn("qb", F.pmod(hashed, F.lit(query_blocks)).cast("int")).withColumn("rb", blocks(row_blocks))
    columns = ["qb", "rb", "asks", "id", "x", "code"]
    jobs = one.withColumn("asks", F.lit(0)).select(columns).unionByName(two.withColumn("asks", F.lit(1)).select(columns))
    jobs = jobs.repartition(max(1, min(row_blocks * query_blocks, 20_000)), "qb", "rb").sortWithinPartitions("qb", "rb", "asks", "id")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in pieces(batches, ["qb", "rb"], 1):
            starts = np.flatnonzero(group_starts(some, ["qb", "rb"]))
            for s, e in zip(starts, [*starts[1:], some.num_rows]):
                job = some.slice(s, e - s)
                cut = int((job.column("asks").to_numpy() == 0).sum())
                held, asked = job.slice(0, cut), job.slice(cut)
                if not held.num_rows or not asked.num_rows:
                    continue
                q, row = probe(_matrix(held, "code", np.uint16), _matrix(asked, "code", np.uint16), model.radius)
                x, y = _matrix(held, "x", np.float64), _matrix(asked, "x", np.float64)
                ids, asks = held.column("id").to_numpy(), asked.column("id").to_numpy()
                other = ids[row] != asks[q]
                q, row = q[other], row[other]
                score = np.concatenate([
                    np.einsum("ij,ij->i", y[q[a : a + 100_000]], x[row[a : a + 100_000]]) for a in range(0, len(q), 100_000)
                ] or [np.zeros(0)])
                order = np.lexsort((ids[row], -score, q))
                q, row, score = q[order], row[order], score[order]
                first = np.searchsorted(q, q)
                best = np.arange(len(q)) - first < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asks[q[best]]), pa.array(ids[row[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    return jobs.mapInArrow(answer, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int, names: DataFrame | None) -> DataFrame:
    """The ``k`` best rows of each query, ties by the id that a row has in the table."""
    found = found.withColumn("real", F.col("vec_id"))
    if names is not None:
        real = names.select(F.col("key").alias("vec_id"), F.col("real").alias("_real"))
        found = found.join(real, "vec_id", "left").withColumn("real", F.coalesce("_real", "vec_id")).drop("_real")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "real", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, asks, k: int = 20, ident: str = "vec_id", vector: str = "embedding",
            sample: int = 10_000) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query.

    Queries are the rows of ``vectors`` where the condition ``asks`` holds; every other row is a
    candidate. Codes are learned from at most ``sample`` vectors (smallest id hashes), but every
    row is indexed. The radius holds 98 % of the sample's own neighbours. A query that finds fewer
    than ``k`` rows within it is searched again over all codes, so each gets ``k`` rows, or all
    there are. Scores are inner products in double precision.

    Null, zero and non-finite vectors, null ids, and vectors of another length than most take no
    part. Rows that repeat an id and vector count once; rows that repeat an id with another vector are
    candidates (and queries) of their own.
    """
    spark = vectors.sparkSession
    arrow_bounds(spark)
    rows = vectors.select(F.col(ident).alias("id"), F.col(vector).alias("x"), F.coalesce(asks, F.lit(False)).alias("ask"))
    rows = rows.where(usable(F.col("x")) & F.col("id").isNotNull())
    usual = rows.groupBy(F.size("x").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("top"),
    ).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if usual is None:
        return empty
    dim = usual["dim"]
    rows, names = apart(rows.where(F.size("x") == dim), "id", F.xxhash64("x"), "vector-ids")
    rows = rows.dropDuplicates(["id"])
    few = rows.withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(sample).collect()
    model = learn(np.array([r.x for r in few], np.float64), float(np.sqrt(usual["top"])), k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dim).astype(np.float64)
            ask = batch.column("ask").to_numpy(zero_copy_only=False)
            for flag in (False, True):
                use = np.ones(len(x), bool) if not flag else ask
                code = model.codes(x[use], lift=not flag)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").filter(pa.array(use)), pa.array([v.tobytes() for v in x[use]], pa.binary()),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.full(int(use.sum()), flag))],
                    ["id", "x", "code", "query"],
                )

    coded = written(rows.mapInArrow(encode, "id long, x binary, code binary, query boolean"), "codes")
    held, asked = coded.where("NOT query").drop("query"), coded.where("query").drop("query")
    found = written(_ranked(_search(asked, held, model, k), k, names), "found")
    short = found.groupBy("query_id").count().where(F.col("count") < k).select("query_id")
    lost = asked.join(found.select(F.col("query_id").alias("id")), "id", "left_anti").select(F.col("id").alias("query_id"))
    short = written(short.unionByName(lost), "short")
    if not short.isEmpty():
        again = asked.join(short.withColumnRenamed("query_id", "id"), "id", "left_semi")
        model = CodeModel(model.turn, model.top, BITS)
        whole = _ranked(_search(again, held, model, k), k, names)
        found = found.join(short, "query_id", "left_anti").unionByName(whole)
    if names is not None:
        real = names.select(F.col("key").alias("query_id"), F.col("real").alias("_asked"))
        found = found.join(real, "query_id", "left").withColumn("query_id", F.coalesce("_asked", "query_id"))
    return found.select("query_id", "rank", F.col("real").alias("vec_id"), "score")
