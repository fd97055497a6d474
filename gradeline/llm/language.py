"""Language identification by mixture inference: EM over words, language set by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import arrow_bounds, held_out, written

BUCKETS = 1 << 15
#: Bytes of text handled at once in a worker.
SLICE = 1 << 20
#: Bytes of likelihoods by word that a worker keeps between rounds.
KEPT = 64 << 20
UNKNOWN = "und"

# Letters and all bytes of longer UTF-8 sequences count as letters; the rest separates words.
_LETTER = np.zeros(256, np.uint8)
_LETTER[ord("a"): ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams around each letter of a lower-cased text, and where words start in them."""
    c = _LETTER[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    inside = c[1:-1] > 0
    starts = np.flatnonzero((c[:-2] == 0)[inside])
    with np.errstate(over="ignore"):
        hashed = (code[inside] * np.uint32(2654435761)) >> np.uint32(17)
    return hashed, starts


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """Parts of at most ``size`` bytes, cut at a blank where there is one."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b" ", at, at + size)
        cut = cut if cut > at else at + size
        yield data[at:cut]
        at = cut
    yield data[at:]


@dataclass
class LanguageModel:
    """Log probabilities of hashed trigrams by language; its size is buckets times languages."""

    languages: list[str]
    log_prob: np.ndarray  # (BUCKETS, languages)

    def words(self, hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log likelihood of each word (rows) under each language (columns)."""
        return np.add.reduceat(self.log_prob[hashed], starts, axis=0)

    def chunks(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words of all texts in chunks of bounded size: hashed trigrams, where words start in
        them, and each word's text. Trigrams take two bytes, so a chunk is about its text's size."""
        room = max(1 << 12, 4 * SLICE // max(len(self.languages), 8))
        out, held, have = [], [], 0

        def close():
            ends = np.cumsum([0] + [len(h) for h, _, _ in held])
            out.append((
                np.concatenate([h for h, _, _ in held]),
                np.concatenate([s + e for (_, s, _), e in zip(held, ends)]),
                np.concatenate([np.full(len(s), i, np.int32) for _, s, i in held]),
            ))

        for i, data in enumerate(texts):
            for part in slices(data, room):
                hashed, starts = trigrams(part)
                if not len(starts):
                    continue
                held.append((hashed.astype(np.uint16), starts.astype(np.int32), i))
                have += len(hashed)
                if have >= room:
                    close()
                    held, have = [], 0
        if held:
            close()
        return out

    def mixtures(self, texts: list[bytes], rounds: int = 6, cost: float = 2.0) -> np.ndarray:
        """Language proportions of each text; languages outside its selected set have 0.

        EM gives each text's proportions over all languages. The sets considered are the first
        1, 2, ... languages in falling order of proportion, until the penalised likelihood has
        fallen twice in a row. Each set is fitted again and the one with the largest log likelihood
        minus ``cost * size * log(words)`` is kept. Likelihoods by word are kept up to ``KEPT``
        bytes and computed again in each round beyond that, so memory does not follow them.
        """
        n, k = len(texts), len(self.languages)
        best = np.zeros((n, k))
        parts = self.chunks(texts) if k else []
        if not parts:
            return best
        sizes = sum(np.bincount(of, minlength=n) for _, _, of in parts)
        remembered: list[np.ndarray] = []
        room = KEPT

        def likelihoods(at: int) -> np.ndarray:
            nonlocal room
            if at < len(remembered):
                return remembered[at]
            log = self.words(*parts[at][:2])
            like = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -60.0))
            if at == len(remembered) and like.nbytes <= room:
                remembered.append(like)
                room -= like.nbytes
            return like

        firsts = [np.flatnonzero(np.diff(of, prepend=-1)) for _, _, of in parts]

        def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
            for _ in range(rounds):
                summed = np.zeros((n, k))
                for at, (_, _, of) in enumerate(parts):
                    joint = share[of] * likelihoods(at)
                    joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
                    summed[of[firsts[at]]] += np.add.reduceat(joint, firsts[at], axis=0)
                share = summed / np.maximum(sizes, 1)[:, None]
            total = np.zeros(n)
            for at, (_, _, of) in enumerate(parts):
                seen = np.log(np.maximum((share[of] * likelihoods(at)).sum(axis=1), 1e-300))
                total[of[firsts[at]]] += np.add.reduceat(seen, firsts[at])
            return share, total

        share, _ = fit(np.ones((n, k)))
        order = np.argsort(-share, axis=1, kind="stable")
        kept, last, falls = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, int)
        for size in range(1, k + 1):
            allowed = np.zeros((n, k))
            np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
            fitted, value = fit(allowed)
            value = value - cost * size * np.log(np.maximum(sizes, 2))
            better = (falls < 2) & (value > kept)
            best[better], kept[better] = fitted[better], value[better]
            falls = np.where(falls >= 2, falls, np.where(value < last, falls + 1, 0))
            last = value
            if (falls[sizes > 0] >= 2).all():
                break
        best[sizes == 0] = 0
        return best


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def hash_cuts(rows: DataFrame, lang: str, most: int) -> dict:
    """By language the bound on ``_h`` that its first ``most`` rows stay within, by histograms.

    Three passes count rows by 12 more bits of the hash; only the slice that holds the last row
    is cut further, so no task orders a language. The last slice counts whole: it is 2^-36 of all
    hashes. Languages of fewer rows than ``most`` have no entry.
    """
    rows = written(rows.select(lang, "_h"), "language-hashes")
    taken: dict = {}
    within: dict = {}
    for bits in (52, 40, 28):
        part = F.shiftright("_h", bits)
        inside = rows
        if bits < 52:
            if not within:
                break
            bound = F.create_map(*[F.lit(x) for pair in within.items() for x in pair])
            inside = rows.where(F.shiftright("_h", bits + 12) == F.element_at(bound, F.col(lang)))
        counts: dict = {}
        for r in inside.groupBy(lang, part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r[lang], []).append((r.part, r.n))
        within = {}
        for name, found in counts.items():
            for at, n in sorted(found):
                if taken.get(name, 0) + n >= most:
                    within[name] = at
                    break
                taken[name] = taken.get(name, 0) + n
    return {name: ((at + 1) << 28) - 1 for name, at in within.items()}


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id",
        per_language: int = 2000) -> LanguageModel:
    """Learn trigram probabilities from at most ``per_language`` documents of each language.

    Those with the smallest id hashes are taken, among rows with a language and a text whose id is
    not held out (rows that share an id stay together; without an id the text is hashed). Only sums
    by language and bucket or hash slice reach the driver. No rows give an empty model.
    """
    arrow_bounds(docs.sparkSession)
    ids = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(ident))
    ids = ids.withColumn("_h", F.xxhash64(ident, F.when(F.col(ident).isNull(), F.col(text))))
    cuts = hash_cuts(ids, lang, per_language)
    # One number per language: a lookup in the scan, where a join would shuffle texts by language.
    cut = F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col(lang)) if cuts else F.lit(None)
    sample = ids.where(F.coalesce(F.col("_h") <= cut, F.lit(True))).select(lang, lowered(F.col(text)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for part in slices(data):
                    held += np.bincount(trigrams(part)[0], minlength=BUCKETS)
        for name, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(held[at])],
                ["lang", "bucket", "n"],
            )

    counts = sample.mapInArrow(count, "lang string, bucket int, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    languages = sorted({r.lang for r in rows}, key=lambda x: x.encode())
    table = np.full((BUCKETS, len(languages)), 0.5)
    for r in rows:
        table[r.bucket, languages.index(r.lang)] += r.n
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and n_languages to each row.

    lang_pred is the language with the largest proportion (ties to the first in code point order),
    score that proportion, n_languages the size of the selected set. A null text, a text without a
    letter, or an empty model gives ``und`` with score 0.
    """
    arrow_bounds(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, n_languages int")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names = model.languages
        found = []
        group: list[bytes] = []
        size = 0
        for data in texts:
            group.append(data)
            size += len(data)
            if size >= SLICE:
                found.append(model.mixtures(group))
                group, size = [], 0
        if group:
            found.append(model.mixtures(group))
        share = np.concatenate(found) if found else np.zeros((0, len(names)))
        if not names:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "n_languages": 0})
        best = share.argmax(axis=1)
        value = np.minimum(share[np.arange(len(share)), best], 1.0)
        return pd.DataFrame({
            "lang_pred": [names[b] if v > 0 else UNKNOWN for b, v in zip(best, value)],
            "score": value,
            "n_languages": (share > 0).sum(axis=1).astype(np.int32),
        })

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    shown = F.when(lettered, F.col(text))
    return docs.withColumn("_p", predict(lowered(shown))).withColumns({
        "lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score"), "n_languages": F.col("_p.n_languages"),
    }).drop("_p")
