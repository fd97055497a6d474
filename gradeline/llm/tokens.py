"""Token counts by heap-and-linked-list byte-pair merging: symbols minus merges, no identifiers."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import arrow_bounds

#: Letters and signs of the first 256 code points, whose lower case and normal form are plain.
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]+")
#: The split of the vocabulary file on such (lower-cased) text; fixed values.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merged_length(symbols: list[int], rank_of: dict[int, int], made: list[int]) -> int:
    """Symbols left after merging, lowest rank first and leftmost among equals.

    ``rank_of`` has the rank of a pair of symbols (first shifted by 20 bits, plus second), ``made``
    the symbol that a rank makes. The symbols form a linked list; a heap holds adjacent pairs by
    rank and place in one integer. An entry whose pair has changed since is passed over.
    """
    n = len(symbols)
    get = rank_of.get
    heap = []
    for i in range(n - 1):
        r = get(symbols[i] << 20 | symbols[i + 1])
        if r is not None:
            heap.append(r << 32 | i)
    if not heap:
        return n
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        entry = pop(heap)
        rank, i = entry >> 32, entry & 0xFFFFFFFF
        j = after[i]
        if j < 0 or get(symbols[i] << 20 | symbols[j]) != rank:
            continue
        new = symbols[i] = made[rank]
        k = after[i] = after[j]
        after[j] = -1
        merges += 1
        if k >= 0:
            before[k] = i
            r = get(new << 20 | symbols[k])
            if r is not None:
                push(heap, r << 32 | i)
        p = before[i]
        if p >= 0:
            r = get(symbols[p] << 20 | new)
            if r is not None:
                push(heap, r << 32 | p)
    return n - merges


class Bounded:
    """Remembers ``make(key)``; forgets everything when ``limit`` keys are held."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.known = make, limit, {}

    def values(self, keys: list) -> list:
        """The value of each key."""
        got = list(map(self.known.get, keys))
        if None in got:
            for i, value in enumerate(got):
                if value is None:
                    key = keys[i]
                    value = self.known.get(key)
                    if value is None:
                        value = self.make(key)
                        if len(self.known) >= self.limit:
                            self.known.clear()
                        self.known[key] = value
                    got[i] = value
        return got


class WordVocabulary:
    """A word-based BPE file (``tokenizers`` JSON whose symbols end in a word mark).

    White space only separates words in such files, so a text is the sum of its blank-separated
    chunks. Special strings inside a text are taken whole, as the library does by default.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        mark = spec["model"]["end_of_word_suffix"]
        if not mark:
            raise ValueError(f"{path}: only vocabularies with word ends are counted by words")
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        self.library = Tokenizer.from_file(path)
        ids = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = {ids[a] << 20 | ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + mark] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.pieces = Bounded(self._piece, limit)
        self.chunks = Bounded(self._chunk, limit)

    def split(self, chunk: str) -> list[bytes]:
        """The UTF-8 pieces of one chunk without special strings."""
        if PLAIN.fullmatch(chunk):
            return [p.encode() for p in SPLIT.findall(chunk.lower())]
        plain = self.library.normalizer.normalize_str(chunk)
        found = self.library.pre_tokenizer.pre_tokenize_str(plain)
        return [bytes([self.byte_of[c] for c in p]) for p, _ in found if p]

    def _piece(self, piece: bytes) -> int:
        inner = self.inner
        symbols = [inner[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        return merged_length(symbols, self.rank_of, self.made)

    def _chunk(self, chunk: bytes) -> int:
        text = chunk.decode("utf-8", "replace")
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.pieces.values([p for t in parts if t for p in self.split(t)]))

    def count(self, data: bytes) -> int:
        return sum(self.chunks.values(data.split()))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> WordVocabulary:
    """One per worker process and file; its memory is bounded and outlives single tasks."""
    return WordVocabulary(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a string column under the vocabulary file at ``path`` (present on every node)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        one = vocabulary(path).count
        return pd.Series([one(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")).cast("binary"))


def with_token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to each row. A null text counts as empty: 0 and 0."""
    arrow_bounds(docs.sparkSession)
    counted = docs.withColumn("n_tokens", token_count(F.col(text), path))
    return counted.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "over_limit": F.col("n_tokens") > limit,
    })
