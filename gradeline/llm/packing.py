"""Best-fit packing of token pieces into fixed-length sequences with a bounded set of open bins."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import arrow_bounds, written
from gradeline.llm.tokens import PLAIN, SPLIT, Bounded, byte_letters

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Bounded-space online best fit.

    The free spaces of the open bins are the set bits of one integer; under each bit lies a stack
    of bins. An item goes to the open bin with the least free space that holds it, found by a shift
    and the lowest set bit. When all ``most`` bins are open and none holds the item, the fullest
    closes.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        out = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return out

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item of ``size``, 1 to the capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._pop(free)
        else:
            if self.open == self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.stacks[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


class WordIds:
    """Identifiers of texts by the ``tokenizers`` library, remembered for words already met."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        if not getattr(self.model, "end_of_word_suffix", None):
            raise ValueError(f"{path}: only vocabularies with word ends may be cut at blanks")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.letters = byte_letters()
        self.pieces = Bounded(self._piece, limit)
        self.chunks = Bounded(self._chunk, limit)

    def _piece(self, piece: str) -> bytes:
        letters = self.letters
        shown = "".join([letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and not self.special.search(text):
            return b"".join(self.pieces.values(SPLIT.findall(text.lower())))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, data: bytes) -> bytes:
        """Unsigned 32-bit identifiers of a UTF-8 text, little-endian."""
        return b"".join(self.chunks.values(data.split()))


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: a document's identifiers and a closing 0, cut only if over ``capacity``.

    A null text counts as empty and yields the one piece that holds the closing 0.
    """
    arrow_bounds(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path).encode
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = memoryview(encode(text or b"") + b"\0\0\0\0")
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 8192, share: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (column length, 1 to ``capacity``).

    Pieces are dealt by a hash to as many tasks as hold about ``share`` pieces each and are packed
    there from the longest down, ties by hash, so reruns and retried tasks agree. Each task holds
    at most ``open_bins`` open bins and streams the rest. Input of any size only adds tasks.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    tasks = max(1, math.ceil(pieces.count() / share))
    key = F.xxhash64("doc_id", "piece")
    if "ids_crc32" in columns:
        # Rows without an id would all meet in one task.
        key = F.when(F.col("doc_id").isNull(), F.xxhash64("ids_crc32", "length", "piece")).otherwise(key)
    dealt = pieces.withColumn("_h", key).repartition(tasks, "_h").sortWithinPartitions(
        F.desc("length"), "_h", "doc_id", "piece", "start"
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            placed = np.array([bins.place(n) for n in lengths], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(placed[:, 0] + first), pa.array(placed[:, 1])],
                [*columns, "sequence_id", "offset"],
            )

    arrow_bounds(spark)
    return dealt.mapInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, open_bins: int = 8192) -> DataFrame:
    """Cut ``docs`` (doc_id, text) into pieces and pack them; see ``token_pieces`` and ``pack``."""
    return pack(written(token_pieces(docs, path, capacity), "pieces"), capacity, open_bins)
