"""Near-duplicate documents: banded MinHash, odd sketches, confirmation on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import (
    apart, arrow_bounds, block_jobs, components, group_starts, mix64, pieces, uint64, written,
)

#: MinHash values are cut into bands: two sets of similarity 0.8 miss all of them 3 times in a million.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 1024
#: Standard errors by which a sketch's estimate may fall short before a pair is ruled out.
SLACK = 4.0
#: Most members in one block of a bucket.
BLOCK = 1000

_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_ODD = (_RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_SALT = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z in lower case.

    A text with fewer words than ``width`` has its whole sequence as one shingle, one without words
    has none. Hashes carry the length of their shingle.
    """
    words = data.lower().split()
    n = min(width, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    h = uint64(map(xxhash.xxh3_64_intdigest, words), len(words))
    with np.errstate(over="ignore"):
        g = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            g = mix64(g * _STEP + h[j : len(h) - n + 1 + j])
    return np.unique(g)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` minima of a set that is not empty."""
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    half = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(half), 2048):
            np.minimum(low, ((half[at : at + 2048] ^ _XOR) * _ODD).min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One key per band; a key also tells its band."""
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            key = mix64(key * _STEP + low[j::ROWS].astype(np.uint64))
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parities of how many MinHash values fall on each bit."""
    with np.errstate(over="ignore"):
        at = (mix64(low.astype(np.uint64) + _SALT) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def most_flips(percent: int) -> int:
    """Most differing bits of two sketches whose sets may reach ``percent`` similarity."""
    like = percent / 100
    least = max(like - SLACK * np.sqrt(like * (1 - like) / SAMPLES) - 0.01, 0.0)
    return int(np.ceil(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - least)))))


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: set size, 128-bit digest of the set, band keys and odd sketch."""
    arrow_bounds(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, sketches = [], [], [], []
            for data in batch.column(1).to_pylist():
                s = shingle_set(data or b"", width)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    low = min_hashes(s)
                    keys.append(bands(low))
                    sketches.append(odd_sketch(low))
                else:
                    keys.append(None)
                    sketches.append(None)
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                 pa.array(keys, kind), pa.array(sketches, kind)],
                ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(sign, SIGNED)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or b"", width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "s"])

    arrow_bounds(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(make, "id long, s binary")


def alike(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two whole sets have at least ``percent`` similarity."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    shared = int((x[at] == y).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have at least ``percent`` similarity."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _flips(a: str, b: str):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n
    )


JOB = ["key", "lo", "hi"]


def _candidates(rows: pa.Table, flips: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each job in ``rows``: row numbers i, j of the pairs in different components that sketches
    do not rule out, and how many bits tell them apart."""
    n = rows.num_rows
    roots, part, lo, hi = (rows.column(c).to_numpy() for c in ("root", "part", "lo", "hi"))
    # Unsigned: numpy counts the bits of the absolute value of signed integers.
    sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)
    starts = np.flatnonzero(group_starts(rows, JOB))
    for s, e in zip(starts, [*starts[1:], n]):
        left, right, apart = [], [], []
        for i in range(s, e - 1):
            j = np.arange(i + 1, e)
            j = j[(roots[j] != roots[i]) & ((lo[i] == hi[i]) | (part[j] != part[i]))]
            far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1)
            near = far <= flips
            left.append(np.full(int(near.sum()), i))
            right.append(j[near])
            apart.append(far[near])
        if left:
            yield np.concatenate(left), np.concatenate(right), np.concatenate(apart)


def _across(members: DataFrame, sketches: DataFrame, sets: DataFrame, flips: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join all components whose members share a bucket and are alike.

    A first pass over sketches tells which members of a job have a candidate in another component.
    Only those bring their sets to the job, where candidates are confirmed, nearest first, until
    both sides are joined. So a job sends fewer links than it has members.
    """
    jobs = written(block_jobs(members, ["key"], "id", BLOCK), "jobs")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*JOB).sortWithinPartitions(*JOB, "id")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, JOB, 4 * BLOCK):
            use = np.zeros(rows.num_rows, bool)
            for i, j, _ in _candidates(rows, flips):
                use[i] = use[j] = True
            yield from rows.select([*JOB, "id"]).filter(pa.array(use)).to_batches()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, JOB, BLOCK):
            ids, roots, packed = rows.column("id").to_pylist(), rows.column("root").to_pylist(), rows.column("s")
            found = []
            for left, right, apart in _candidates(rows, flips):
                lead: dict[int, int] = {}

                def top(r: int) -> int:
                    while r in lead:
                        r = lead[r]
                    return r

                for k in np.argsort(apart, kind="stable"):
                    i, j = int(left[k]), int(right[k])
                    x, y = top(roots[i]), top(roots[j])
                    if x != y and alike(packed[i].as_py(), packed[j].as_py(), percent):
                        lead[max(x, y)] = min(x, y)
                        found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
            links = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    seen = dealt(jobs.join(sketches, "id").select(*JOB, "part", "id", "root", "sketch"))
    asked = seen.mapInArrow(ask, "key long, lo int, hi int, id long")
    brought = jobs.join(asked, [*JOB, "id"]).join(sketches, "id").join(sets, "id")
    brought = dealt(brought.select(*JOB, "part", "id", "root", "sketch", "s"))
    return brought.mapInArrow(join, "a long, b long").distinct()


def duplicate_classes(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Documents with equal sets form a class at once, whatever their number. Class representatives
    that share a band are linked in two steps. First, in a few rounds, each compares itself with
    one member of each of its buckets and confirms the one with the nearest sketch, which joins
    most of a group by as many pairs as it has members. Then all pairs that share a bucket but not
    a component are compared by sketches in bounded blocks, and those not ruled out are confirmed
    on whole sets there, nearest first, until their components are joined. So no link is left out
    that would join two components, and no group is sent as pairs.

    Null and blank texts have no shingles and link with nothing. Rows with a null id take no part:
    their component is null and they are kept. Rows that repeat an id and text share a component;
    rows that repeat an id with another text are documents of their own.
    """
    flips = most_flips(percent)
    docs, names = apart(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id", F.xxhash64("text"), "classes")
    sig = written(signatures(docs, width), "signatures")
    some = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id")), "classes")
    chosen = some.join(reps.withColumnRenamed("id", "doc_id"), ["d1", "d2", "doc_id"], "left_semi")
    sketches = chosen.select(F.col("doc_id").alias("id"), "sketch").dropDuplicates(["id"])
    cells = chosen.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct()
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    cells = written(cells.join(shared, "key"), "buckets")
    sketches = written(sketches.join(cells.select("id").distinct(), "id", "left_semi"), "sketches")
    sets = docs.join(sketches.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = written(shingle_sets(sets, width), "sets")

    links = None
    roots = sketches.select("id", F.col("id").alias("root"))
    for turn in range(rounds + 1):
        members = cells.join(roots, "id")
        if turn:
            mixed = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"))
            members = members.join(mixed.where("x < y").select("key"), "key", "left_semi")
        if turn < rounds:
            head = members.groupBy("key").agg(F.min_by("id", F.xxhash64(F.lit(turn), "key", "id")).alias("b"))
            near = members.join(head, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
            near = near.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
            near = near.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
            near = near.withColumn("far", _flips("x", "y")).where(F.col("far") <= flips)
            pairs = near.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
            new = confirmed(pairs, sets, percent)
        else:
            new = _across(members, sketches, sets, flips, percent)
        new = written(new, f"confirmed-{turn}")
        links = new if links is None else links.unionByName(new)
        if turn == rounds and new.isEmpty():
            break
        found = components(links, "near")
        roots = written(sketches.select("id").join(found, sketches["id"] == found["node"], "left").select(
            "id", F.coalesce("root", "id").alias("root")), "roots")
    out = sig.select("doc_id", "n_shingles", "d1", "d2").join(reps, ["d1", "d2"], "left")
    out = out.join(roots, "id", "left")
    whole = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("component_id", F.when(whole, F.coalesce("root", "id")).otherwise(F.col("doc_id")))
    if names is not None:
        out = out.join(names, out["doc_id"] == names["key"], "left").withColumn("doc_id", F.coalesce("real", "doc_id"))
        least = out.groupBy(F.col("component_id").alias("_c")).agg(F.min("doc_id").alias("_least"))
        out = out.join(least, out["component_id"] == least["_c"], "left").withColumn("component_id", F.col("_least"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.c AS component_id, w.doc_id = k.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) k ON k.a = w.doc_id
"""
