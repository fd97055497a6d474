"""Cross-tokenizer alignment: lockstep merging of two token sequences over the same bytes.

Texts are cut into pieces where both tokenizers must end a token, mostly words; of a batch the libraries
read each distinct piece once. Runs of pieces are the lanes of the merge. One NumPy state vector holds, for
every lane of a batch, the current token of each tokenizer and the bytes where they end. A step emits
a link for every lane, advances the token that ends first (both at a cut), and drops finished lanes.

Documents travel in blocks that carry their own dictionary of linked id pairs, so that corpus-wide
counts meet each pair once per block, however many documents share it, and come back the same way.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import arrow_bounds, written
from gradeline.llm.tokens import byte_letters

#: Pieces of a lane, characters of text read at once, characters of text of a block.
LANE, AT_ONCE, BLOCK = 150, 4 << 20, 4 << 20
#: Pieces whose tokens are merged at once, and distinct pieces that the libraries read at once: what a worker
#: holds beside its text follows these numbers.
PART, READ = 170_000, 2048
#: Documents of a block.
BLOCK_DOCS = 50_000
#: A block is a row of megabytes. Parquet's writer would look at its buffer every 100 rows only, and its
#: reader decodes a row group's blocks together: row groups of a few blocks keep both small, however many
#: blocks a task has.
FEW_BLOCKS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Tokens beyond which a lane is cut at ends that the two sequences happen to share.
LONG_LANE = 4096
#: A single blank between such characters starts a token of either kind.
SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Bits of an id in a pair's key.
ID_BITS = 20


class Sides:
    """The two tokenizers: ids of texts, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core; threads of the library would only take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # Blanks must only lead in pieces, else a token could reach over a cut.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.stride = max(len(self.a_bytes), len(self.b_bytes))
        ids = [str(i).encode() for i in range(self.stride)]
        #: What each token adds to a document's written groups, by its place in the group.
        self.shown = [i + mark for mark in (b",", b"|", b",", b";") for i in ids]

    def pieces(self, text: str) -> list[str]:
        """The parts of a text, each to be read with a blank before it."""
        return SAFE.split(text) if self.cuts else [text]

    def read(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Number of each piece among the distinct ones; which of these have tokens whose bytes differ from
        a blank and the piece; for either tokenizer the ids of all distinct pieces and how many each has."""
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        odd = np.zeros(len(distinct), dtype=bool)
        parts: list[tuple[list, list]] = [([], []), ([], [])]
        # Many short-lived lists: looking for cycles among them would take longer than they live.
        gc.disable()
        try:
            for at in range(0, len(distinct), READ):
                some = distinct[at : at + READ]
                whole = [" " + p for p in some]
                found = [e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)], self.b.encode(some, num_threads=1)
                for ids, known, (flats, sizes) in zip(found, (self.a_bytes, self.b_bytes), parts):
                    flat = list(chain.from_iterable(ids))
                    if b"".join(map(known.__getitem__, flat)) != "".join(whole).encode():
                        odd[at : at + READ] |= [b"".join([known[i] for i in own]) != p.encode() for own, p in zip(ids, whole)]
                    flats.append(np.array(flat, dtype=np.int64))
                    sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        finally:
            gc.enable()
        sides = [(np.concatenate(flats), np.concatenate(sizes)) for flats, sizes in parts]
        return coded.indices.to_numpy(), odd, sides


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> Sides:
    """One per worker process and pair of files."""
    return Sides(path_a, path_b)


def gathered(ids: np.ndarray, sizes: np.ndarray, number: np.ndarray, lane: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of pieces, given the ids and sizes of the distinct ones, and their number per lane."""
    size = sizes[number]
    begin = (np.cumsum(sizes) - sizes)[number]
    place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    return ids[place], np.bincount(lane, size, n).astype(np.int64)


def merged(a_size: np.ndarray, b_size: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A place, B place) of all lanes, and which A and B tokens end at a cut.

    ``a_size`` and ``b_size`` are the bytes of the tokens of all lanes, one lane after another;
    ``a_start`` and ``b_start`` the places of each lane's first tokens. Lanes hold equal bytes on both
    sides and at least one token.
    """
    a_stop = np.append(a_start[1:], len(a_size))
    a, b, stop = a_start.copy(), b_start.copy(), a_stop
    a_end, b_end = a_size[a], b_size[b]
    a_more, b_more = np.append(a_size, 0), np.append(b_size, 0)
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        on_a, on_b = a_end <= b_end, b_end <= a_end
        cut = on_a & on_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + on_a, b + on_b
        live = a < stop
        if not live.all():
            a, b, stop, a_end, b_end, on_a, on_b = (v[live] for v in (a, b, stop, a_end, b_end, on_a, on_b))
        a_end, b_end = a_end + a_more[a] * on_a, b_end + b_more[b] * on_b
    last_a, last_b = np.zeros(len(a_size), bool), np.zeros(len(b_size), bool)
    last_a[np.concatenate(cuts_a)] = True
    last_b[np.concatenate(cuts_b)] = True
    return np.concatenate(links_a), np.concatenate(links_b), last_a, last_b


def shorter(a_size: np.ndarray, b_size: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane starts with long lanes cut further, at ends that both sequences share."""
    a_stop, b_stop = np.append(a_start[1:], len(a_size)), np.append(b_start[1:], len(b_size))
    long = np.flatnonzero(a_stop - a_start > LONG_LANE)
    if not len(long):
        return a_start, b_start
    more_a, more_b = [a_start], [b_start]
    for i in long:
        a_end, b_end = np.cumsum(a_size[a_start[i] : a_stop[i]]), np.cumsum(b_size[b_start[i] : b_stop[i]])
        _, at_a, at_b = np.intersect1d(a_end[:-1], b_end[:-1], assume_unique=True, return_indices=True)
        chosen = np.unique(np.searchsorted(at_a, np.arange(LONG_LANE // 2, len(a_end), LONG_LANE // 2)))
        chosen = chosen[chosen < len(at_a)]
        more_a.append(a_start[i] + at_a[chosen] + 1)
        more_b.append(b_start[i] + at_b[chosen] + 1)
    return np.sort(np.concatenate(more_a)), np.sort(np.concatenate(more_b))


class Block:
    """Documents whose linked pairs are counted together."""

    def __init__(self, both: Sides):
        self.both, self.bytes = both, 0
        self.ids: list = []
        self.void: list[bool] = []
        self.counts: list[np.ndarray] = []
        self.digests: list = []
        self.started: list[bool] = []
        self.pending: list[tuple[int, list[str]]] = []
        self.waiting = 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ident, text: str | None) -> None:
        doc = len(self.ids)
        self.ids.append(ident)
        self.void.append(not text)
        self.counts.append(np.zeros(4, dtype=np.int64))
        self.digests.append(hashlib.sha256())
        self.started.append(False)
        self.bytes += len(text or "")
        pieces = self.both.pieces(text) if text else []
        for at in range(0, len(pieces), LANE):
            lane = pieces[at : at + LANE]
            self.pending.append((doc, lane))
            self.waiting += sum(map(len, lane))
            if self.waiting >= AT_ONCE:
                self.merge()

    def merge(self) -> None:
        """Tokenize and merge the lanes gathered so far."""
        both, lanes = self.both, self.pending
        self.pending, self.waiting = [], 0
        if not lanes:
            return
        per_lane = np.array([len(pieces) for _, pieces in lanes])
        docs = np.array([doc for doc, _ in lanes])
        number, odd, sides = both.read(list(chain.from_iterable(pieces for _, pieces in lanes)))
        del lanes
        for doc in np.unique(np.repeat(docs, per_lane)[odd[number]]):
            self.void[doc] = True
        ends = np.cumsum(per_lane)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PART, ends[-1], PART)) + 1, len(docs)))
        for i, j in zip([0, *cuts], cuts):
            self._merge_part(number[ends[i] - per_lane[i] : ends[j - 1]], sides, docs[i:j], per_lane[i:j])

    def _merge_part(self, number: np.ndarray, sides: list, docs: np.ndarray, per_lane: np.ndarray) -> None:
        """Merge some of the lanes that were read: numbers of their pieces, and their documents."""
        both = self.both
        good = ~np.array(self.void, dtype=bool)[docs]
        number = number[np.repeat(good, per_lane)]
        docs, per_lane = docs[good], per_lane[good]
        if not len(docs):
            return
        lane = np.repeat(np.arange(len(docs)), per_lane)
        (a, per_a), (b, per_b) = (gathered(*side, number, lane, len(docs)) for side in sides)
        a_start, b_start = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        a_size, b_size = both.a_size[a], both.b_size[b]
        link_a, link_b, last_a, last_b = merged(a_size, b_size, *shorter(a_size, b_size, a_start, b_start))
        doc_a = np.repeat(docs, per_a)
        n = len(self.ids)
        groups, links = np.bincount(doc_a[last_a], minlength=n), np.bincount(doc_a[link_a], minlength=n)
        sums = np.stack([np.bincount(doc_a, minlength=n), np.bincount(np.repeat(docs, per_b), minlength=n), groups, links], axis=1)
        for doc in np.unique(docs):
            self.counts[doc] += sums[doc]
        self._write(a, b, last_a, last_b, doc_a)
        pair = a[link_a] << ID_BITS | b[link_b]
        # A document's number above the pair's 40 bits; blocks hold far fewer documents than 2**23.
        keys, times = np.unique(doc_a[link_a] << 2 * ID_BITS | pair, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def _write(self, a, b, last_a, last_b, doc_a) -> None:
        """Add the groups to the documents' digests: A ids, a bar, B ids, a semicolon after each but the last."""
        both = self.both
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        before_b, until_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        order = np.empty(len(a) + len(b), dtype=np.int64)
        doc = np.empty(len(order), dtype=np.int64)
        place = np.arange(len(a)) + before_b[group_a]
        order[place] = a + both.stride * last_a
        doc[place] = doc_a
        place = np.arange(len(b)) + until_a[group_b]
        order[place] = b + both.stride * (2 + last_b)
        doc[place] = doc_a[np.flatnonzero(last_a)[group_b]]
        starts = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        show = both.shown.__getitem__
        for i, j in zip(starts, starts[1:]):
            written_groups = b"".join(map(show, order[i:j].tolist()))
            digest = self.digests[doc[i]]
            # The mark after the last group so far is due only now that another one follows.
            digest.update(b";" * self.started[doc[i]] + written_groups[:-1])
            self.started[doc[i]] = True

    def record(self, number: int) -> dict:
        """The block as one row."""
        self.merge()
        void = np.array(self.void, dtype=bool)
        keys = np.concatenate([*self.keys, np.zeros(0, np.int64)])
        times = np.concatenate([*self.times, np.zeros(0, np.int64)])
        keys, where = np.unique(keys, return_inverse=True)
        times = np.bincount(where, weights=times, minlength=len(keys)).astype(np.int64)
        doc = keys >> 2 * ID_BITS
        good = ~void[doc]
        doc, pair, times = doc[good], keys[good] & (1 << 2 * ID_BITS) - 1, times[good]
        pairs, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
        counts = np.array(self.counts).reshape(-1, 4) * ~void[:, None]
        return {
            "block": number, "ids": self.ids, "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 3],
            "shas": ["" if v else d.hexdigest() for v, d in zip(self.void, self.digests)],
            "ends": np.cumsum(np.bincount(doc, minlength=len(void))), "places": place.astype(np.int32), "times": times.astype(np.int32),
            "pairs": pairs, "docs": docs,
        }


def blocks_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block of documents: their counts and digests, and their pairs against its own dictionary."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, "
        "ends array<long>, places array<int>, times array<int>, pairs array<long>, docs array<long>"
    )
    arrow = _arrow_schema(docs, schema)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = sides(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(both)
        for batch in batches:
            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                block.add(ident, text.as_py())
                if block.bytes >= BLOCK or len(block.ids) >= BLOCK_DOCS:
                    yield pa.RecordBatch.from_pylist([block.record(number)], arrow)
                    block, number = Block(both), number + 1
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.record(number)], arrow)

    return docs.select("doc_id", "text").mapInArrow(align, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best) over all documents: how many hold the pair, and whether no pair of its A id has more."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("s")).groupBy(F.col("s.pairs").alias("pair")).agg(F.sum("s.docs").alias("n"))
    a = F.shiftright("pair", ID_BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.select("*", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers read a blank and the text, without special tokens. A null or empty text has no
    tokens, and neither has one whose tokens' bytes, joined, differ from that on either side: all
    numbers are 0 and the digest is the empty string. Repeated rows and ids are documents of their
    own, a null id too. Other columns are not looked at. The files are read on every node.
    """
    spark = docs.sparkSession
    arrow_bounds(spark)
    blocks = written(blocks_of(docs, path_a, path_b), "token-blocks", FEW_BLOCKS)
    counts = written(link_counts(blocks), "token-links")
    own = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    arrow = _arrow_schema(docs, schema)

    def total(block: pa.Table, known: pa.Table) -> pa.Table:
        """The documents of one block, given what is known of each pair of its dictionary."""
        ids, n_a, n_b, n_groups, n_links, shas, ends, places, times = (
            block.column(c).combine_chunks().flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "shas", "ends", "places", "times")
        )
        places, times, ends = places.to_numpy(), times.to_numpy().astype(np.int64), ends.to_numpy()
        at = known.column("at").to_numpy()
        n, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
        n[at], best[at] = known.column("n").to_numpy(), known.column("best").to_numpy()

        def per_doc(values: np.ndarray) -> pa.Array:
            sums = np.concatenate([[0], np.cumsum(values)])
            return pa.array(np.diff(sums[ends], prepend=0))

        columns = [ids, n_a, n_b, n_groups, n_links, per_doc(times * best[places]), per_doc(times * n[places]), shas]
        return pa.Table.from_arrays(columns, schema=arrow)

    # Rows of pairs are sorted by block on disk where need be; gathered into arrays they would be objects in the heap.
    return blocks.drop("pairs", "docs").groupBy("block").cogroup(own.groupBy("of")).applyInArrow(total, schema)
