"""Repeated passages: compressed FM-indexes per shard and matching statistics of streamed segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import apart, arrow_bounds, mix64, pieces, uint64, written

#: Words of an anchor. A window is sent where its smallest-hashed run of so many words is sent, so
#: equal windows always meet in one shard.
ANCHOR = 6
#: Anchors that occur more often have their windows dealt one by one.
HOT = 10_000
#: Segments of one index.
SHARD_ROWS = 20_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(data: bytes) -> np.ndarray:
    words = data.split()
    return uint64(map(xxhash.xxh3_64_intdigest, words), len(words))


def segments(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each run of windows with one anchor place.

    At most ``window - ANCHOR + 1`` windows share an anchor.
    """
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - ANCHOR + 1, np.uint64)
        for j in range(ANCHOR):
            g = (g ^ h[j : len(g) + j]) * _STEP
            g ^= g >> np.uint64(29)
    least, place = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - ANCHOR + 1):
        lower = g[j : j + n] < least
        least[lower] = g[j : j + n][lower]
        place[lower] = j
    at = place + np.arange(n)
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    first = np.flatnonzero(new)
    return least[first].view(np.int64), first, np.diff(np.append(first, n))


class FMIndex:
    """FM-index of an integer text in a wavelet matrix of packed bits.

    ``text`` holds symbols from 1 up; 0 ends a segment. Suffixes are in full order, as each runs
    into an end mark of its own.
    """

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        ends = text == 0
        marks = int(ends.sum())
        rank = text + (marks - 1)
        rank[ends] = np.arange(marks)
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        step = 1
        order = np.argsort(rank)
        while rank[order[-1]] != n - 1:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            both = rank * (n + 1) + after
            order = np.argsort(both)
            ranked = both[order]
            new = np.zeros(n, np.int64)
            new[1:] = ranked[1:] != ranked[:-1]
            rank[order] = np.cumsum(new)
            step *= 2
        self.places = order.astype(np.int32)
        last = text[order - 1]
        symbols = int(text.max()) + 1 if n else 1
        counts = np.bincount(last, minlength=symbols)
        self.levels = []
        row = last
        for shift in reversed(range(max(1, (symbols - 1).bit_length()))):
            bit = (row >> shift & 1).astype(np.uint8)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view(np.uint64)
            ones = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.levels.append((shift, words, ones, n - int(bit.sum())))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        smaller = np.cumsum(counts) - counts
        self.base = smaller - self._descend(np.arange(symbols), np.zeros(symbols, np.int64))
        self.lows = [self.places]
        while 2 << len(self.lows) - 1 <= max(1, counts[1:].max(initial=1)):
            below, half = self.lows[-1], 1 << len(self.lows) - 1
            self.lows.append(np.minimum(below[:-half], below[half:]))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, words, ones, zeros in self.levels:
            word = i >> 6
            below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            r = ones[word] + np.bitwise_count(words[word] & below)
            i = np.where(symbol >> shift & 1, zeros + r, i - r)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` followed by what ``lo`` and ``hi`` bound: one backward step."""
        n = len(lo)
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        both += np.concatenate([self.base[symbol], self.base[symbol]])
        return both[:n], both[n:]

    def first_place(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest text place in each interval, none of them empty."""
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            table = self.lows[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << int(k))])
        return out


def repeats(index: FMIndex, begin: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """For each place of the index's text, whether a window that starts there occurs before it.

    Each segment (``begin``, ``size``) is streamed from its right end: backward search extends the
    match while it has an earlier occurrence. A match of ``window`` words or more settles each
    window at its left end; where a match breaks, the search starts anew with the next window that
    is not settled.
    """
    text, n = index.text, len(index.text)
    found = np.zeros(n, bool)
    end = begin + size
    at, begin = end.copy(), begin.copy()
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
    while len(at):
        new_lo, new_hi = index.extend(text[at - 1], lo, hi)
        some = new_lo < new_hi
        good = np.zeros(len(at), bool)
        good[some] = index.first_place(new_lo[some], new_hi[some]) < at[some] - 1
        at = np.where(good, at - 1, at)
        lo, hi = np.where(good, new_lo, 0), np.where(good, new_hi, n)
        found[at[good & (end - at >= window)]] = True
        fresh = np.where(end - at >= window, at - 1, end - window - 1)
        end = np.where(good, end, fresh + window)
        at = np.where(good, at, end)
        left = np.where(good, at > begin, fresh >= begin)
        begin, end, at, lo, hi = begin[left], end[left], at[left], lo[left], hi[left]
    return found


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, tx, n): distinct anchors of each document, a hash of its text, occurrences."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids, texts, counts = [], [], [], []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                anchor, n = np.unique(segments(hashed_words(data or b""), window)[0], return_counts=True)
                found.append(anchor)
                counts.append(n)
                ids.append(np.full(len(n), doc, np.int64))
                texts.append(np.full(len(n), np.uint64(xxhash.xxh3_64_intdigest(data or b"")).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (found, ids, texts, counts)],
                ["anchor", "doc_id", "tx", "n"],
            )

    return docs.mapInArrow(find, "anchor long, doc_id long, tx long, n long")


SEGMENT = "key long, doc_id long, start long, windows int, words binary"


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """Segments of the documents' repeated anchors; of equal ones in a batch only the first has words.

    Windows of frequent anchors are segments of their own, under a key that also holds their words.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("doc_id").to_numpy(), kind="stable")
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            anchors, hots = batch.column("anchors").to_pylist(), batch.column("hots").to_pylist()
            seen: dict[tuple[int, bytes], tuple[int, int]] = {}
            rows = []
            for r in order:
                doc = ids[r]
                h = hashed_words(texts[r].as_py())
                anchor, first, count = segments(h, window)
                wanted = np.array(anchors[r], np.int64)
                frequent = set(np.array(hots[r], np.int64).tolist())
                for k in np.flatnonzero(np.isin(anchor, wanted)):
                    a, s, c = int(anchor[k]), int(first[k]), int(count[k])
                    parts = [(s + i, 1) for i in range(c)] if a in frequent else [(s, c)]
                    for start, windows in parts:
                        words = h[start : start + windows + window - 1].tobytes()
                        key = a
                        if a in frequent:
                            key = xxhash.xxh3_64_intdigest(words) - (1 << 63)
                        known = seen.setdefault((key, words), (doc, start))
                        if known == (doc, start):
                            rows.append((key, doc, start, windows, words))
                        else:
                            rows.append((key, doc, start, windows, None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "doc_id", "start", "windows", "words"])

    return docs.select("doc_id", "text", "anchors", "hots").mapInArrow(cut, SEGMENT)


def _judged(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, bits): bit i tells whether the window at start + i occurs earlier."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches, ["key"], SHARD_ROWS):
            keys, ids, starts = (rows.column(c).to_numpy() for c in ("key", "doc_id", "start"))
            again = np.zeros(len(ids), bool)
            again[1:] = (keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1]) & (starts[1:] == starts[:-1])
            words = [np.frombuffer(w, np.uint64) for w in rows.column("words").to_pylist()]
            words = [w for w, a in zip(words, again) if not a]
            size = np.array([len(w) for w in words])
            begin = np.cumsum(size + 1) - size - 1
            text = np.zeros(int((size + 1).sum()), np.int64)
            inside = np.ones(len(text), bool)
            inside[begin + size] = False
            text[inside] = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
            hit = repeats(FMIndex(text), begin, size, window)
            bits = np.zeros(len(size), np.int64)
            for i in range(int(size.max()) - window + 1):
                has = i <= size - window
                bits[has] |= hit[begin[has] + i].astype(np.int64) << i
            some = bits > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[~again][some]), pa.array(starts[~again][some]), pa.array(bits[some])], ["doc_id", "start", "bits"])

    dealt = found.where("words IS NOT NULL").repartition("key").sortWithinPartitions("key", "doc_id", "start")
    told = dealt.select("key", "doc_id", "start", "words").mapInArrow(judge, "doc_id long, start long, bits long")
    whole = F.expr("shiftleft(1L, windows) - 1").alias("bits")
    return told.unionByName(found.where("words IS NULL").select("doc_id", "start", whole))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text and kept_sha256.

    Each word covered by a window of ``window`` words that also starts earlier (smaller doc_id, or
    earlier in the same document) is removed; kept words are joined by one space.

    Equal texts are settled by their digest. Otherwise only windows whose anchor occurs elsewhere
    can repeat; they travel, by anchor, to shards, each of which indexes its segments and streams
    them through the index. A null text has no words. Rows with a null id neither lose words nor
    make others lose them. Rows that repeat an id and text count as one document; of those with
    another text each counts as a document after all others.
    """
    if not ANCHOR < window <= ANCHOR + 62:
        raise ValueError(f"window must be {ANCHOR + 1} to {ANCHOR + 62} words")
    arrow_bounds(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    docs, names = apart(docs, "doc_id", F.xxhash64("text"), "repeats")
    known = docs.where(F.col("doc_id").isNotNull())
    texts = written(known.select("doc_id", F.md5("text").alias("digest")), "digests")
    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = texts.join(firsts, "digest").where("doc_id > first").select("doc_id").distinct()
    copies = written(copies, "copies")

    anchors = written(_anchors(known, window), "anchors")
    often = anchors.groupBy("anchor").agg(
        F.min("tx").alias("x"), F.max("tx").alias("y"), F.max("n").alias("m"), F.sum("n").alias("c"))
    often = often.where("x <> y OR m > 1").select("anchor", (F.col("c") > HOT).alias("hot"))
    wanted = anchors.select("anchor", "doc_id").join(often, "anchor").groupBy("doc_id").agg(
        F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hots"))
    wanted = wanted.join(copies, "doc_id", "left_anti")
    found = written(_segments(known.join(wanted, "doc_id"), window), "segments")
    bits = written(_judged(found, window), "judged")

    marks = bits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))
    marks = marks.unionByName(copies.select("doc_id", F.lit(None).cast("array<struct<start:bigint,bits:bigint>>").alias("marks")))
    marks = marks.withColumn("copy", F.col("marks").isNull())
    out = docs.join(marks, "doc_id", "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts, digests = [], [], [], []
            told = zip(*(batch.column(c).to_pylist() for c in ("text", "marks", "copy")))
            for data, at, copy in told:
                words = data.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if copy and len(words) >= window:
                    gone[:] = 1
                elif at:
                    for m in at:
                        start, left = m["start"], m["bits"]
                        while left:
                            i = (left & -left).bit_length() - 1
                            gone[start + i] += 1
                            gone[start + i + window] -= 1
                            left &= left - 1
                    gone = np.cumsum(gone)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                text = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(texts, pa.binary()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    out = out.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
    if names is not None:
        out = out.join(names, out["doc_id"] == names["key"], "left").withColumn("doc_id", F.coalesce("real", "doc_id"))
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"), "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY c ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM late),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(p.x, ' ' ORDER BY p.k) AS t
         FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w) p
         LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.k = p.k WHERE g.k IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
