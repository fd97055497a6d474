"""Integer hashes that any SQL engine can repeat: plain BIGINT arithmetic, no overflow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the 32-bit mixer: multiplier, mask, and the odd constant that spreads seeds.
MIX = 73244475
MASK = 4294967295
GOLDEN = 2654435769


def with_draw(df: DataFrame, out: str, seed: int, a: Column, b: Column) -> DataFrame:
    """Add a well-mixed 32-bit value for the pair ``(a, b)`` of small non-negative integers.

    The steps are separate projections, so each intermediate value is computed once.
    """
    df = df.withColumn(out, (a * GOLDEN + seed).bitwiseAND(F.lit(MASK)))
    for stage in range(2):
        for _ in range(2):
            x = F.col(out)
            df = df.withColumn(out, x.bitwiseXOR(F.shiftright(x, 16)) * MIX)
            df = df.withColumn(out, F.col(out).bitwiseAND(F.lit(MASK)))
        x = F.col(out)
        df = df.withColumn(out, x.bitwiseXOR(F.shiftright(x, 16)))
        if stage == 0:
            df = df.withColumn(out, F.col(out).bitwiseXOR(b.cast("bigint")))
    return df


def text_hash32(c: Column, word: int = 0) -> Column:
    """One 32-bit word of the MD5 of a string as BIGINT."""
    return F.conv(F.substring(F.md5(c), 1 + 8 * word, 8), 16, 10).cast("bigint")


#: Bits of the second word that leave room for an iteration number in a draw.
SECOND = (1 << 30) - 1


def with_cluster_draw(df: DataFrame, out: str, seed: int, it: Column, cluster: str) -> DataFrame:
    """Add a 32-bit draw of (iteration, cluster); 62 bits tell the clusters apart."""
    first, second = cluster_words(cluster)
    df = df.withColumn(f"{out}a", first + it)
    df = with_draw(df, out, seed, F.col(f"{out}a"), second)
    return df.drop(f"{out}a")


def cluster_words(cluster: str) -> tuple[Column, Column]:
    """The two words of a cluster's name that a draw mixes; an iteration is added to the first."""
    return text_hash32(F.col(cluster), 1).bitwiseAND(F.lit(SECOND)), text_hash32(F.col(cluster))


def mix_draws(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """:func:`with_draw` of whole arrays: all its steps are taken modulo 2^32."""
    x = a * np.uint32(GOLDEN)
    x += np.uint32(seed & MASK)
    for stage in range(2):
        for _ in range(2):
            x ^= x >> np.uint32(16)
            x *= np.uint32(MIX)
        x ^= x >> np.uint32(16)
        if stage == 0:
            x ^= b
    return x
