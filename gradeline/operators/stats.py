"""Document-clustered intervals, paired tests and clustering diagnostics.

Everything starts from one row per (leg, document) with two sums, so the work after the first
aggregate grows with documents and not with fields.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradeline.functions.hashing import cluster_words, mix_draws
from gradeline.functions.ratio import count_if, share

# Paired verdicts need at least this many documents; resamples; error level.
MIN_CLUSTERS = 20
ITERATIONS = 2000
ALPHA = 0.05
# Bounds of a task of the resampling: documents weighted at a time, and bytes of sums kept before they are sent.
CHUNK = 256
HELD = 64 << 20
#: 32-bit upper ends of the Poisson distribution of mean 1, by value.
POISSON = [
    math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)))
    for k in range(12)
]


def check_parameters(iters: int, alpha: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie in (0, 1), not {alpha!r}")
    if iters < 1:
        raise ValueError(f"iters must be at least 1, not {iters!r}")


def per_cluster(outcomes: DataFrame, by: list[str], cluster: str = "doc") -> DataFrame:
    """Fields and right fields per (by, document)."""
    return outcomes.groupBy(*by, cluster).agg(
        F.count("*").cast("bigint").alias("n"),
        count_if(F.col("status") == "correct").alias("c"),
    )


PLAIN = -1


def iterations(iters: int, first: int = 0) -> Column:
    return F.sequence(F.lit(first).cast("bigint"), F.lit(iters - 1).cast("bigint"))


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as the session shuffles into.

    The document table is small in bytes and would be coalesced into one task, although each of its
    rows becomes thousands of draws.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def resample(
    outcomes: DataFrame, by: list[str], *, iters: int, seed: int, cluster: str = "doc"
) -> DataFrame:
    """Resample documents ``iters`` times per group and add up every leg's sums.

    In each iteration a document counts as often as a Poisson draw of mean 1 says, a pure hash of
    (seed, iteration, document). So no join and no document numbers are needed, weights are made
    and summed where the document lies, any two legs see the same weights whatever else is in the
    batch, and only tasks x legs x iterations sums are shuffled. The weights of a few documents are
    one matrix, made once for all legs, and their sums are its product with the legs' columns; no
    row per draw is made. Iteration ``PLAIN`` takes every document once and yields the point
    estimate. An iteration that draws none of a leg's documents has no row for it.
    """
    docs = per_cluster(outcomes, [*by, "parser"], cluster)
    names = [f"_b{i}" for i in range(len(by))]
    wide = docs.groupBy(*by, cluster).agg(F.collect_list(F.struct("parser", "n", "c")).alias("legs"))
    first, second = cluster_words(cluster)
    legs = F.col("legs")
    wide = spread(wide).select(
        *[F.col(c).alias(n) for c, n in zip(by, names)], first.alias("first"), second.alias("second"),
        *[legs[c].alias(c) for c in ("parser", "n", "c")],
    )
    keys = [*wide.schema.fields[: len(by)], docs.schema["parser"]]
    made = StructType([*keys, *[StructField(c, LongType()) for c in ("it", "n", "c", "n_docs")]])
    sums = wide.mapInArrow(partial(_weighted_sums, names, iters, seed), made)
    return sums.groupBy(*names, "parser", "it").agg(
        *[F.sum(c).alias(c) for c in ("n", "c", "n_docs")]
    ).where("n_docs > 0").select(*[F.col(n).alias(c) for c, n in zip(by, names)], "parser", "it", "n", "c", "n_docs")


def poisson_weights(first: np.ndarray, second: np.ndarray, iters: int, seed: int) -> np.ndarray:
    """Weights (documents x iterations): Poisson values of :func:`hashing.with_cluster_draw`."""
    h = mix_draws(first[:, None] + np.arange(iters, dtype=np.uint32), second[:, None], seed)
    weights = np.zeros(h.shape, dtype=np.uint8)
    for t in POISSON:
        weights += h >= np.uint32(t)
    return weights


def _weighted_sums(names: list[str], iters: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums per (group, leg, iteration), each group's documents times their weights."""
    held: dict[tuple, np.ndarray] = {}
    its = np.arange(PLAIN, iters, dtype=np.int64)

    def rows(schema: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for key, total in held.items():
            seen = total[2] > 0
            n = int(seen.sum())
            keys = [pa.repeat(pa.scalar(v, t), n) for v, t in zip(key, schema)]
            columns = [*keys, pa.array(its[seen]), *[pa.array(total[i][seen]) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "parser", "it", "n", "c", "n_docs"])
        held.clear()

    types: list[pa.DataType] = []
    for batch in batches:
        types = [*[batch.column(c).type for c in names], batch.column("parser").type.value_type]
        groups = np.zeros(batch.num_rows, dtype=np.int64)
        for c in names:
            codes = pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            groups = np.unique(groups * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        order = np.argsort(groups, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(groups[order])) + 1, len(order))
        start = 0
        for end in ends:
            for at in range(start, end, CHUNK):
                part = batch.take(pa.array(order[at : min(at + CHUNK, end)]))
                group = tuple(part.column(c)[0].as_py() for c in names)
                for leg, total in _chunk_sums(part, iters, seed):
                    key = (*group, leg)
                    if key in held:
                        held[key] += total
                    else:
                        held[key] = total
                if len(held) * 24 * len(its) > HELD:
                    yield from rows(types)
            start = end
    yield from rows(types)


def _chunk_sums(part: pa.RecordBatch, iters: int, seed: int) -> Iterator[tuple[object, np.ndarray]]:
    """Legs of a few documents of one group with n, c and documents drawn, the plain iteration first."""
    lists = part.column("parser")
    legs = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
    at = (np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy()), legs.indices.to_numpy())
    sums = np.zeros((3, len(part), len(legs.dictionary)), dtype=np.int64)
    sums[0][at], sums[1][at] = (part.column(c).flatten().to_numpy() for c in ("n", "c"))
    sums[2][at] = 1
    first, second = (pc.fill_null(part.column(c), 0).to_numpy().astype(np.uint32) for c in ("first", "second"))
    weights = poisson_weights(first, second, iters, seed)
    # A document without a name is never drawn.
    weights[~part.column("first").is_valid().to_numpy(zero_copy_only=False)] = 0
    times = np.ascontiguousarray(weights.T, dtype=np.float64)
    exact = int(sums[0].sum()) * len(POISSON) < 2**53
    drawn = lambda w, x: (w @ x.astype(np.float64)).astype(np.int64) if exact else w.astype(np.int64) @ x
    fields = drawn(times, np.concatenate([sums[0], sums[1]], axis=1))
    docs = drawn((times > 0).astype(np.float64), sums[2])
    k = len(legs.dictionary)
    for j, leg in enumerate(legs.dictionary.to_pylist()):
        total = np.empty((3, iters + 1), dtype=np.int64)
        total[:, 0] = sums[:, :, j].sum(axis=1)
        total[0, 1:], total[1, 1:], total[2, 1:] = fields[:, j], fields[:, k + j], docs[:, j]
        yield leg, total


def interval(
    stats: DataFrame, by: list[str], value: Column, alpha: float, point: list[Column]
) -> DataFrame:
    """Percentile interval (linear interpolation) beside values of the plain iteration."""
    plain = F.col("it") == PLAIN
    bounds = F.percentile(
        F.when(~plain, value), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    )
    return stats.groupBy(*by).agg(*point, bounds.alias("_q")).withColumns(
        {"lo": F.col("_q")[0], "hi": F.col("_q")[1]}
    ).drop("_q")


def at_plain(c: Column) -> Column:
    return F.max(F.when(F.col("it") == PLAIN, c))


def cluster_bootstrap_ci(
    outcomes: DataFrame, by: list[str] = (), *, iters: int = ITERATIONS, seed: int = 0,
    alpha: float = ALPHA,
) -> DataFrame:
    """Interval of each leg's accuracy over all fields, documents resampled within ``by``."""
    check_parameters(iters, alpha)
    stats = resample(outcomes, list(by), iters=iters, seed=seed)
    acc = share(F.col("c"), F.col("n"))
    point = [
        at_plain(acc).alias("acc"), at_plain(F.col("n")).alias("n"),
        at_plain(F.col("n_docs")).alias("n_docs"),
    ]
    return interval(stats, [*by, "parser"], acc, alpha, point)


def separable(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def paired_clusters(outcomes: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Both legs' document sums side by side over the union of their documents.

    ``pairs`` holds (a, b) leg names, a set as small as the leaderboard. A document that one leg
    lacks adds nothing to that leg.
    """
    docs = per_cluster(outcomes, [*by, "parser"])
    side = lambda leg, n, c: docs.join(
        pairs.withColumnRenamed(leg, "parser"), "parser"
    ).select(
        *by,
        *([F.col("parser").alias("a"), "b"] if leg == "a" else ["a", F.col("parser").alias("b")]),
        "doc", F.col("n").alias(n), F.col("c").alias(c),
    )
    both = side("a", "na", "ca").join(side("b", "nb", "cb"), [*by, "a", "b", "doc"], "full_outer")
    return both.fillna(0, ["na", "ca", "nb", "cb"])


def pair_sizes(outcomes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Documents in the union of both legs of each pair."""
    both = paired_clusters(outcomes, pairs.select("a", "b"), [])
    return both.groupBy("a", "b").agg(F.count("*").alias("n_docs"))


def paired_delta_ci(
    outcomes: DataFrame, pairs: DataFrame, *, iters: int = ITERATIONS, seed: int = 0,
    alpha: float = ALPHA,
) -> DataFrame:
    """Interval of accuracy(a) - accuracy(b) with the same drawn documents on both legs.

    All pairs read one batch of draws; what is paired is one row per (leg, iteration). ``n_docs``
    is each pair's own union of documents.
    """
    check_parameters(iters, alpha)
    named = pairs.select(F.explode(F.array("a", "b")).alias("parser")).distinct()
    rows = outcomes.join(named, "parser", "left_semi")
    acc = resample(rows, [], iters=iters, seed=seed).select(
        "parser", "it", share(F.col("c"), F.col("n")).alias("acc")
    )
    a = acc.select(F.col("parser").alias("a"), "it", F.col("acc").alias("acc_a"))
    b = acc.select(F.col("parser").alias("b"), "it", F.col("acc").alias("acc_b"))
    stats = a.join(pairs, "a").join(b, ["b", "it"])
    delta = F.col("acc_a") - F.col("acc_b")
    ci = interval(stats, ["a", "b"], delta, alpha, [at_plain(delta).alias("delta")])
    return ci.join(pair_sizes(rows, pairs), ["a", "b"]).select("a", "b", "delta", "n_docs", "lo", "hi")


def verdict(n_docs: Column, lo: Column, hi: Column) -> Column:
    return (
        F.when(n_docs < MIN_CLUSTERS, "insufficient clusters")
        .when(~separable(lo, hi), "not separable")
        .when(lo > 0, "a ahead")
        .otherwise("b ahead")
    )


def leg_pairs(legs: DataFrame) -> DataFrame:
    """Each unordered pair of legs within a section once, in label order.

    Legs number as many as the leaderboard has rows, and they meet by section.
    """
    a = legs.select("section", F.col("parser").alias("a"))
    b = legs.select("section", F.col("parser").alias("b"))
    return a.join(b, "section").where(F.col("a") < F.col("b")).select("section", "a", "b")


def pairwise_separability(
    outcomes: DataFrame, legs: DataFrame, *, iters: int = ITERATIONS, seed: int = 0,
    alpha: float = ALPHA,
) -> DataFrame:
    """Verdict for every pair of a section, from one batch of draws."""
    pairs = leg_pairs(legs)
    ci = paired_delta_ci(outcomes, pairs.select("a", "b"), iters=iters, seed=seed, alpha=alpha)
    rows = pairs.join(ci, ["a", "b"])
    return rows.withColumn("verdict", verdict(F.col("n_docs"), F.col("lo"), F.col("hi")))


def beats_majority(
    outcomes: DataFrame, majority: DataFrame, *, name: str = "majority",
    iters: int = ITERATIONS, seed: int = 0, alpha: float = ALPHA,
) -> DataFrame:
    """``yes``, ``no``, ``not separable`` or ``insufficient clusters`` per system.

    ``majority`` is the predictor's leg, called ``name``. One batch of draws serves all systems; the
    predictor's value reaches them through a window over the legs of an iteration.
    """
    check_parameters(iters, alpha)
    cols = ["parser", "qid", "key", "doc", "status"]
    rows = outcomes.select(*cols).unionByName(majority.select(*cols))
    acc = resample(rows, [], iters=iters, seed=seed).select(
        "parser", "it", share(F.col("c"), F.col("n")).alias("acc")
    )
    base = F.max(F.when(F.col("parser") == name, F.col("acc"))).over(Window.partitionBy("it"))
    delta = F.col("acc") - F.col("base")
    ci = interval(
        acc.withColumn("base", base).where((F.col("parser") != name) & F.col("base").isNotNull()),
        ["parser"], delta, alpha, [at_plain(delta).alias("delta")],
    )
    legs = outcomes.select(F.col("parser").alias("a"), F.lit(name).alias("b")).distinct()
    sizes = pair_sizes(rows, legs).select(F.col("a").alias("parser"), "n_docs")
    ci = ci.join(sizes, "parser").select("parser", "delta", "n_docs", "lo", "hi")
    v = verdict(F.col("n_docs"), F.col("lo"), F.col("hi"))
    return ci.withColumn(
        "verdict", F.when(v == "a ahead", "yes").when(v == "b ahead", "no").otherwise(v)
    )


def log_gamma(x: Column) -> Column:
    """Natural log of gamma for x >= 1: Stirling's series after a shift by eight."""
    z = x + 8.0
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    return (
        (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - F.log(product)
    )


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts; NULL without discordant pairs.

    The tail starts at the smaller count and walks down by term ratios. Terms more than
    ``12 * sqrt(n)`` away are below 1e-120 of the largest, so the walk has that length and not n.
    """
    n = (b + c).cast("double")
    k = F.least(b, c).cast("double")
    top = F.exp(
        log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2)
    )
    steps = F.least(k, F.ceil(F.sqrt(n) * 12) + 50).cast("int")
    start = F.struct(top.alias("sum"), top.alias("term"), k.alias("k"), n.alias("n"))
    walk = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(
        F.array().cast("array<int>")
    )

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (acc["k"] - j + 1) / (acc["n"] - acc["k"] + j)
        return F.struct(
            (acc["sum"] + term).alias("sum"), term.alias("term"),
            acc["k"].alias("k"), acc["n"].alias("n"),
        )

    tail = F.aggregate(walk, start, step, lambda acc: acc["sum"])
    return F.when(b + c > 0, F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """p, agreement and a note for rows with both / a_only / b_only / neither counts."""
    n = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    discordant = F.col("a_only") + F.col("b_only")
    return pairs.withColumns(
        {
            "discordant": discordant,
            "p": mcnemar_p(F.col("a_only"), F.col("b_only")),
            "agreement": share(F.col("both") + F.col("neither"), n),
            "note": F.when(discordant == 0, "no discordant pairs").otherwise("tested"),
        }
    )


def generation_mcnemar(gradings: DataFrame, old: str, new: str) -> DataFrame:
    """Two gradings of the same cells, per leg and pooled (``parser`` NULL)."""
    hit = F.coalesce("match", F.lit(False))
    a = gradings.where(F.col("generation") == old).select("qid", "parser", hit.alias("a"))
    b = gradings.where(F.col("generation") == new).select("qid", "parser", hit.alias("b"))
    both = a.join(b, ["qid", "parser"])
    counts = both.rollup("parser").agg(
        count_if(F.col("a") & F.col("b")).alias("both"),
        count_if(F.col("a") & ~F.col("b")).alias("a_only"),
        count_if(~F.col("a") & F.col("b")).alias("b_only"),
        count_if(~F.col("a") & ~F.col("b")).alias("neither"),
    )
    return mcnemar(counts)


def icc_by_cluster(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Intraclass correlation of correctness by document, design effect and effective n.

    One-way ANOVA from per-document sums: for a 0/1 value the sum of squares equals the sum.
    """
    docs = per_cluster(outcomes, by).withColumns(
        {
            "_sq": F.col("c") * F.col("c") / F.col("n").cast("double"),
            "_nn": F.col("n").cast("double") * F.col("n"),
        }
    )
    t = docs.groupBy(*by).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("c").alias("c"),
        F.sum("_sq").alias("sq"),
        F.sum("_nn").alias("nn"),
    )
    n, k, c = F.col("n").cast("double"), F.col("k").cast("double"), F.col("c").cast("double")
    t = t.withColumns(
        {
            "msb": (F.col("sq") - c * c / n) / F.nullif(k - 1, F.lit(0.0)),
            "msw": (c - F.col("sq")) / F.nullif(n - k, F.lit(0.0)),
            "n0": (n - F.col("nn") / n) / F.nullif(k - 1, F.lit(0.0)),
        }
    )
    msb, msw, n0 = F.col("msb"), F.col("msw"), F.col("n0")
    t = t.withColumn("icc", F.try_divide(msb - msw, msb + (n0 - 1) * msw))
    effect = 1 + (n / k - 1) * F.col("icc")
    return t.select(
        *by, F.col("k").alias("n_docs"), F.col("n"), "icc",
        effect.alias("design_effect"), F.try_divide(n, effect).alias("effective_n"),
    )


def band_tests(outcomes: DataFrame, bands: DataFrame, first: str, second: str) -> DataFrame:
    """Split two legs by a document band and test each side."""
    from gradeline.operators.cells import paired_legs

    rows = outcomes.join(bands.select("doc", "band"), "doc")
    counts = paired_legs(rows, first, second, ["band"])
    n = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    return mcnemar(counts).withColumns(
        {
            "n": n,
            "acc_a": share(F.col("both") + F.col("a_only"), n),
            "acc_b": share(F.col("both") + F.col("b_only"), n),
        }
    )


def sample_agreement(samples: DataFrame) -> DataFrame:
    """Share of a cell's repeats that gave its most common answer, per (parser, qid, key)."""
    cell = ["parser", "qid", "key"]
    votes = samples.groupBy(*cell, "value").agg(
        F.count("*").alias("votes"), count_if(F.col("ok")).alias("right")
    )
    lead = F.struct("votes", "value")
    return votes.groupBy(*cell).agg(
        F.sum("votes").alias("k"),
        (F.max("votes") / F.sum("votes")).alias("agreement"),
        (F.max_by("right", lead) > 0).alias("modal_ok"),
    )


def within_arm_sd(samples: DataFrame) -> DataFrame:
    """Standard deviation of accuracy over the repeats of each arm."""
    per_repeat = samples.groupBy("parser", "sample_index").agg(
        share(count_if(F.col("ok")), F.count("*")).alias("acc")
    )
    return per_repeat.groupBy("parser").agg(
        F.count("*").alias("k"), F.avg("acc").alias("mean_acc"),
        F.stddev_samp("acc").alias("sd_acc"),
    )


def review_curve(agreements: DataFrame) -> DataFrame:
    """Review rate against residual error when cells below an agreement level go to a person.

    Levels are shares of a few repeats, so a leg has a handful of rows here.
    """
    level = agreements.groupBy("parser", "agreement").agg(
        F.count("*").alias("n"), count_if(~F.col("modal_ok")).alias("wrong")
    )
    kept = Window.partitionBy("parser").orderBy(F.desc("agreement"))
    whole = Window.partitionBy("parser")
    level = level.withColumns(
        {
            "n_kept": F.sum("n").over(kept),
            "wrong_kept": F.sum("wrong").over(kept),
            "n_all": F.sum("n").over(whole),
        }
    )
    return level.select(
        "parser", F.col("agreement").alias("threshold"), "n_kept",
        share(F.col("n_all") - F.col("n_kept"), F.col("n_all")).alias("review_rate"),
        share(F.col("wrong_kept"), F.col("n_kept")).alias("residual_error"),
    )


def permutation_test(
    outcomes: DataFrame, pairs: DataFrame, *, iters: int = ITERATIONS, seed: int = 0
) -> DataFrame:
    """Document-level paired permutation: the sign of each document's difference is flipped.

    Signs come from hash bits of (iteration, document). They are made as a matrix of a few documents at
    a time, for all pairs at once, and multiplied with the documents' differences: no row per draw, and
    only tasks x pairs x iterations sums are shuffled. ``pairs`` travels as one array value.
    """
    check_parameters(iters, ALPHA)
    every = pairs.agg(F.array_sort(F.collect_set(F.struct("a", "b")))).scalar()
    docs = per_cluster(outcomes, ["parser"]).where("parser IS NOT NULL")
    wide = docs.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("parser", "c"))).alias("legs"))
    wide = wide.withColumn("every", every).withColumn("pairs", F.transform("every", lambda p: F.struct(
        F.element_at("legs", p["a"]).alias("a"), F.element_at("legs", p["b"]).alias("b"))))
    zero = F.lit(0).cast("bigint")
    flag = lambda c: F.coalesce(c.cast("bigint"), zero)
    right = lambda c: F.coalesce(c, zero)
    # A document without a name is not the same one on both sides.
    own = lambda alone, both: F.when(F.col("doc").isNull(), alone).otherwise(both)
    parts = {
        "d": lambda p: right(p["a"]) - right(p["b"]),
        "n": lambda p: own(flag(p["a"].isNotNull()) + flag(p["b"].isNotNull()), flag(p["a"].isNotNull() | p["b"].isNotNull())),
        "moved": lambda p: own(flag(p["a"] != 0) + flag(p["b"] != 0), flag(right(p["a"]) != right(p["b"]))),
    }
    first, second = cluster_words("doc")
    rows = spread(wide).select(
        first.alias("first"), second.alias("second"), *[F.transform("pairs", f).alias(name) for name, f in parts.items()]
    )
    sums = rows.mapInArrow(partial(_flipped_sums, iters, seed), "pair int, it long, s long, n long, moved long")
    sums = sums.groupBy("pair", "it").agg(*[F.sum(c).alias(c) for c in ("s", "n", "moved")])
    plain = F.col("it") == PLAIN
    tests = sums.groupBy("pair").agg(
        *[F.max(F.when(plain, F.col(c))).alias(name) for c, name in (("s", "observed"), ("n", "n_docs"), ("moved", "n_moved"))],
        F.collect_list(F.when(~plain, F.abs("s"))).alias("flipped"),
    ).where("n_docs > 0")
    extreme = F.size(F.filter("flipped", lambda s: s >= F.abs("observed")))
    # Legs that never differ tie with the observed zero in every iteration.
    return tests.withColumn("_p", F.get(every, F.col("pair"))).select(
        "_p.a", "_p.b", "observed", "n_docs", "n_moved", ((extreme + 1) / (iters + 1)).alias("p")
    )


def _flipped_sums(iters: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums per (pair, iteration) of differences with flipped signs; the plain iteration first, with counts."""
    total, counts = None, None
    its = np.arange(iters, dtype=np.uint32)
    for batch in batches:
        if not batch.num_rows:
            continue
        d, n, moved = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("d", "n", "moved"))
        if total is None:
            total, counts = np.zeros((iters + 1, d.shape[1]), dtype=np.int64), np.zeros((2, d.shape[1]), dtype=np.int64)
        total[0] += d.sum(axis=0)
        counts += np.stack([n.sum(axis=0), moved.sum(axis=0)])
        named = batch.column("first").is_valid().to_numpy(zero_copy_only=False)
        first, second = (pc.fill_null(batch.column(c), 0).to_numpy().astype(np.uint32) for c in ("first", "second"))
        some = np.flatnonzero((d != 0).any(axis=1))
        for at in range(0, len(some), CHUNK):
            i = some[at : at + CHUNK]
            flip = mix_draws(first[i, None] + its, second[i, None], seed) & np.uint32(65536) != 0
            flip |= ~named[i, None]
            signs = np.where(flip.T, -1.0, 1.0)
            exact = int(np.abs(d[i]).sum()) < 2**53
            total[1:] += (signs @ d[i].astype(np.float64)).astype(np.int64) if exact else signs.astype(np.int64) @ d[i]
    for k in range(0 if total is None else total.shape[1]):
        head = lambda v: np.append(v, np.zeros(iters, dtype=np.int64))
        columns = [np.full(iters + 1, k, dtype=np.int32), np.arange(PLAIN, iters, dtype=np.int64), total[:, k], head(counts[0, k]), head(counts[1, k])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pair", "it", "s", "n", "moved"])


def holm(tests: DataFrame, by: list[str] = ()) -> DataFrame:
    """Holm-adjusted p over a family of tests (one row per compared pair)."""
    part = Window.partitionBy(*by)
    order = part.orderBy("p", "a", "b")
    step = (F.count("*").over(part) - F.row_number().over(order) + 1) * F.col("p")
    tests = tests.withColumn("_s", step)
    return tests.withColumn(
        "p_holm",
        F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))),
    ).drop("_s")


def random_effects(deltas: DataFrame, by: list[str] = ()) -> DataFrame:
    """Random-effects mean of per-model deltas (columns ``delta``, ``var``) with heterogeneity.

    Two passes over one row per model: fixed weights give Q and the between-model variance, which
    then enters the weights.
    """
    part = Window.partitionBy(*by)
    w = 1 / F.col("var")
    rows = deltas.withColumn("_w", w).withColumns(
        {
            "_sw": F.sum("_w").over(part),
            "_sww": F.sum(F.col("_w") * F.col("_w")).over(part),
            "_mean": F.sum(F.col("_w") * F.col("delta")).over(part) / F.sum("_w").over(part),
            "_k": F.count("*").over(part),
        }
    )
    q = F.sum(F.col("_w") * F.pow(F.col("delta") - F.col("_mean"), 2)).over(part)
    rows = rows.withColumn("_q", q)
    tau2 = F.greatest(
        F.lit(0.0),
        F.coalesce(
            F.try_divide(
                F.col("_q") - (F.col("_k") - 1), F.col("_sw") - F.col("_sww") / F.col("_sw")
            ),
            F.lit(0.0),
        ),
    )
    rows = rows.withColumn("tau2", tau2).withColumn("_v", 1 / (F.col("var") + F.col("tau2")))
    return rows.groupBy(*by).agg(
        F.count("*").alias("k"),
        (F.sum(F.col("_v") * F.col("delta")) / F.sum("_v")).alias("mean"),
        (1 / F.sqrt(F.sum("_v"))).alias("se"),
        F.max("_q").alias("q"),
        F.max("tau2").alias("tau2"),
    )
