"""Queries over clustered statistics and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.functions.hashing import GOLDEN, MASK, MIX, SECOND
from gradeline.operators import metrics, stats
from gradeline.plans import relations as rel
from gradeline.plans.accuracy import R6, SQL_PAIRED, outcomes, paired_legs
from gradeline.plans.catalog import query
from gradeline.plans.relations import SYSTEMS, with_relations

ITERS = stats.ITERATIONS


def sql_draws(source: str, a: str, b: str, keep: str, seed: int = 0) -> str:
    """SQL for the 32-bit draw of (a, b), one nested SELECT per mixing step."""
    s = f"SELECT {keep}, {b} AS _b, ({a} * {GOLDEN} + {seed}) & {MASK} AS h FROM {source}"
    for stage in range(2):
        for _ in range(2):
            s = f"SELECT {keep}, _b, (xor(h, h >> 16) * {MIX}) & {MASK} AS h FROM ({s})"
        s = f"SELECT {keep}, _b, xor(h, h >> 16) AS h FROM ({s})"
        if stage == 0:
            s = f"SELECT {keep}, _b, xor(h, CAST(_b AS BIGINT)) AS h FROM ({s})"
    return s


HASH = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


HASH2 = f"(CAST('0x' || substr(md5({{0}}), 9, 8) AS BIGINT) & {SECOND})"
SQL_WEIGHT = " + ".join(f"CAST(h >= {t} AS INT)" for t in stats.POISSON)


def sql_resample(docs: str, by: str, sums: list[str], iters: int = ITERS) -> dict[str, str]:
    """Tables for resampled sums from ``docs`` (by, doc, sums): Poisson weights by document."""
    return {
        "slots": f"""SELECT {by}, {', '.join(sums)}, {HASH.format('doc')} AS t,
            {HASH2.format('doc')} AS t2, unnest(range(0, {iters})) AS it FROM {docs}""",
        "draws": sql_draws("slots", "(it + t2)", "t", f"{by}, it, {', '.join(sums)}"),
        "stats": f"""SELECT {by}, it, {', '.join(f'sum(w * {s}) AS {s}' for s in sums)}
            FROM (SELECT *, {SQL_WEIGHT} AS w FROM draws) WHERE w > 0 GROUP BY {by}, it""",
    }


def share_sql(c: str, n: str) -> str:
    return f"coalesce({c} / nullif({n}, 0), 0)"


CHECKBOX_DOCS = """SELECT parser, doc, count(*) AS n, count(*) FILTER (WHERE status = 'correct') AS c
  FROM fields WHERE checkbox AND kind = 'bool' GROUP BY parser, doc"""


def boolean_outcomes(spark, sf):
    return metrics.boolean_gold(outcomes(spark, sf))


@query(
    "B01_cluster_bootstrap",
    with_relations(
        "fields",
        f"""SELECT p.*, lo, hi FROM
             (SELECT parser, round(sum(c) / sum(n), 6) AS acc, CAST(sum(n) AS BIGINT) AS n,
                count(*) AS n_docs FROM docs GROUP BY parser) p
           JOIN (SELECT parser, round(quantile_cont({share_sql('c', 'n')}, 0.025), 6) AS lo,
                round(quantile_cont({share_sql('c', 'n')}, 0.975), 6) AS hi
                FROM stats GROUP BY parser) s ON s.parser = p.parser""",
        docs=CHECKBOX_DOCS,
        **sql_resample("docs", "parser", ["n", "c"]),
    ),
)
def cluster_bootstrap(spark, sf):
    return stats.cluster_bootstrap_ci(boolean_outcomes(spark, sf)).withColumns(
        R6("acc", "lo", "hi")
    )


def sql_pairs(legs: str, pairs: str) -> dict[str, str]:
    """Side-by-side document sums of the named pairs."""
    return {
        "legs_docs": legs,
        "pairs": pairs,
        "paired": """SELECT a, b, doc, coalesce(na, 0) AS na, coalesce(ca, 0) AS ca,
            coalesce(nb, 0) AS nb, coalesce(cb, 0) AS cb FROM
            (SELECT a, b, doc, n AS na, c AS ca FROM pairs JOIN legs_docs ON parser = a)
            FULL JOIN (SELECT a, b, doc, n AS nb, c AS cb FROM pairs JOIN legs_docs ON parser = b)
            USING (a, b, doc)""",
    }


DELTA = f"{share_sql('x.c', 'x.n')} - {share_sql('y.c', 'y.n')}"
SQL_DELTA = f"""SELECT p.a, p.b, round(delta, 6) AS delta, n_docs, lo, hi FROM
   (SELECT a, b, {share_sql('sum(ca)', 'sum(na)')} - {share_sql('sum(cb)', 'sum(nb)')} AS delta,
      count(*) AS n_docs FROM paired GROUP BY a, b) p
   JOIN (SELECT a, b, round(quantile_cont({DELTA}, 0.025), 6) AS lo,
      round(quantile_cont({DELTA}, 0.975), 6) AS hi
      FROM pairs JOIN stats x ON x.parser = a JOIN stats y ON y.parser = b AND y.it = x.it
      GROUP BY a, b) s
   ON s.a = p.a AND s.b = p.b"""


@query(
    "B02_paired_delta",
    with_relations(
        "fields",
        SQL_DELTA,
        **sql_pairs(
            CHECKBOX_DOCS, f"SELECT '{SYSTEMS[0]}' AS a, '{SYSTEMS[3]}' AS b"
        ),
        **sql_resample("legs_docs", "parser", ["n", "c"]),
    ),
)
def paired_delta(spark, sf):
    pairs = spark.createDataFrame([(SYSTEMS[0], SYSTEMS[3])], "a string, b string")
    return stats.paired_delta_ci(boolean_outcomes(spark, sf), pairs).withColumns(
        R6("delta", "lo", "hi")
    )


SQL_VERDICT = """CASE WHEN n_docs < 20 THEN 'insufficient clusters'
  WHEN NOT (lo > 0 OR hi < 0) THEN 'not separable' WHEN lo > 0 THEN '{a}' ELSE '{b}' END"""
SQL_SECTION_PAIRS = f"""SELECT x.section, x.parser AS a, y.parser AS b FROM
  (SELECT DISTINCT parser, CASE WHEN p < 3 THEN 'direct' ELSE 'transcriber' END AS section
   FROM cells) x JOIN (SELECT DISTINCT parser, CASE WHEN p < 3 THEN 'direct' ELSE 'transcriber' END
   AS section FROM cells) y ON x.section = y.section AND x.parser < y.parser"""


@query(
    "B04_pairwise_separability",
    with_relations(
        "fields cells",
        f"""SELECT q.section, d.*, {SQL_VERDICT.format(a='a ahead', b='b ahead')} AS verdict
           FROM ({SQL_DELTA}) d JOIN section_pairs q ON q.a = d.a AND q.b = d.b""",
        section_pairs=SQL_SECTION_PAIRS,
        **sql_pairs(CHECKBOX_DOCS, "SELECT a, b FROM section_pairs"),
        **sql_resample("legs_docs", "parser", ["n", "c"]),
    ),
)
def pairwise_separability(spark, sf):
    legs = spark.createDataFrame(
        [(s, "direct" if s.startswith("vlm__") else "transcriber") for s in SYSTEMS],
        "parser string, section string",
    )
    return stats.pairwise_separability(boolean_outcomes(spark, sf), legs).withColumns(
        R6("delta", "lo", "hi")
    )


@query(
    "B05_beats_majority",
    with_relations(
        "fields",
        f"""SELECT a AS parser, delta, n_docs, lo, hi,
             {SQL_VERDICT.format(a='yes', b='no')} AS verdict FROM ({SQL_DELTA})""",
        **sql_pairs(
            CHECKBOX_DOCS
            + """ UNION ALL SELECT 'majority', doc, count(*), count(*) FILTER (WHERE gold_true =
              (SELECT count(*) FILTER (WHERE gold_true) >= count(*) FILTER (WHERE NOT gold_true)
               FROM gold WHERE checkbox AND kind = 'bool'))
              FROM gold WHERE checkbox AND kind = 'bool' GROUP BY doc""",
            "SELECT DISTINCT parser AS a, 'majority' AS b FROM fields",
        ),
        **sql_resample("legs_docs", "parser", ["n", "c"]),
    ),
)
def beats_majority(spark, sf):
    leg = metrics.majority_leg(metrics.boolean_golds(rel.bank(spark, sf)))
    return stats.beats_majority(boolean_outcomes(spark, sf), leg).withColumns(
        R6("delta", "lo", "hi")
    )


SQL_P = """CASE WHEN a_only + b_only > 0 THEN round(least(1, 2 * list_sum(list_transform(
  range(0, CAST(least(a_only, b_only) AS BIGINT) + 1), lambda i: exp(lgamma(a_only + b_only + 1)
  - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))), 6) END"""
SQL_MCNEMAR = f"""SELECT *, a_only + b_only AS discordant, {SQL_P} AS p,
  round(("both" + neither) / ("both" + a_only + b_only + neither), 6) AS agreement,
  CASE WHEN a_only + b_only = 0 THEN 'no discordant pairs' ELSE 'tested' END AS note"""


@query(
    "B06_mcnemar",
    with_relations("fields", f"{SQL_MCNEMAR} FROM pairs", pairs=SQL_PAIRED),
)
def mcnemar(spark, sf):
    return stats.mcnemar(paired_legs(spark, sf)).withColumns(R6("p", "agreement"))


@query(
    "B07_generation_mcnemar",
    with_relations(
        "rows",
        f"""{SQL_MCNEMAR} FROM (SELECT parser, count(*) FILTER (WHERE a AND b) AS both,
             count(*) FILTER (WHERE a AND NOT b) AS a_only,
             count(*) FILTER (WHERE NOT a AND b) AS b_only,
             count(*) FILTER (WHERE NOT a AND NOT b) AS neither
           FROM (SELECT parser, has_answer AND match AS a,
                   (has_answer AND match) <> (q % 23 = 0) AS b FROM rows WHERE p >= 3)
           GROUP BY ROLLUP (parser))""",
    ),
)
def generation_mcnemar(spark, sf):
    old = rel.scored(spark, sf).where("p >= 3").withColumn(
        "match", F.coalesce("match", F.lit(False))
    )
    new = old.withColumn("match", F.col("match") != (F.col("q") % 23 == 0))
    both = old.withColumn("generation", F.lit("g1")).unionByName(
        new.withColumn("generation", F.lit("g2"))
    )
    return stats.generation_mcnemar(both, "g1", "g2").withColumns(R6("p", "agreement"))


@query(
    "B08_icc",
    with_relations(
        "fields",
        """SELECT parser, k AS n_docs, n, round(icc, 6) AS icc,
             round(1 + (n / k - 1) * icc, 6) AS design_effect,
             round(n / (1 + (n / k - 1) * icc), 6) AS effective_n FROM (
           SELECT *, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM (
             SELECT parser, count(*) AS k, CAST(sum(n) AS BIGINT) AS n,
               (sum(c * c / n) - sum(c) * sum(c) / sum(n)) / (count(*) - 1) AS msb,
               (sum(c) - sum(c * c / n)) / (sum(n) - count(*)) AS msw,
               (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0
             FROM docs GROUP BY parser))""",
        docs="""SELECT parser, doc, CAST(count(*) AS DOUBLE) AS n,
          CAST(count(*) FILTER (WHERE status = 'correct') AS DOUBLE) AS c
          FROM fields GROUP BY parser, doc""",
    ),
)
def icc(spark, sf):
    return stats.icc_by_cluster(outcomes(spark, sf), ["parser"]).withColumns(
        R6("icc", "design_effect", "effective_n")
    )


def samples(spark, sf):
    """Five repeats per field of every leg; a repeat now and then flips the verdict."""
    rows = outcomes(spark, sf)
    q = F.substring("qid", 2, 20).cast("bigint")
    ln = F.substring("key", 2, 5).cast("bigint")
    s = F.col("sample_index")
    p = F.array_position(F.array(*[F.lit(x) for x in SYSTEMS]), F.col("parser")) - 1
    flip = (q + ln * 3 + s * 7 + p) % 9 == 0
    rows = rows.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(4))))
    ok = (F.col("status") == "correct") != flip
    value = F.when(ok, "gold").otherwise(F.concat(F.lit("alt"), (s % 2).cast("string")))
    return rows.select("parser", "qid", "key", "sample_index", ok.alias("ok"), value.alias("value"))


SQL_SAMPLES = """SELECT parser, qid, key, s, ok, CASE WHEN ok THEN 'gold' ELSE 'alt' || (s % 2) END
    AS value
  FROM (SELECT *, (status = 'correct') <> ((q + ln * 3 + s * 7 + p) % 9 = 0) AS ok
        FROM (SELECT *, unnest(range(0, 5)) AS s FROM fields))"""
SQL_AGREEMENT = """SELECT parser, qid, key, CAST(sum(v) AS BIGINT) AS k, max(v) / sum(v) AS agreement,
    max_by(r, (v, value)) > 0 AS modal_ok
  FROM (SELECT parser, qid, key, value, count(*) AS v, count(*) FILTER (WHERE ok) AS r
        FROM samples GROUP BY ALL) GROUP BY ALL"""


@query(
    "B10_sample_agreement",
    with_relations(
        "fields",
        "SELECT parser, qid, key, k, round(agreement, 6) AS agreement, modal_ok FROM agreed",
        samples=SQL_SAMPLES, agreed=SQL_AGREEMENT,
    ),
)
def sample_agreement(spark, sf):
    return stats.sample_agreement(samples(spark, sf)).withColumns(R6("agreement"))


@query(
    "B10_within_arm_sd",
    with_relations(
        "fields",
        """SELECT parser, count(*) AS k, round(avg(acc), 6) AS mean_acc,
             round(stddev_samp(acc), 6) AS sd_acc FROM (SELECT parser, s,
             count(*) FILTER (WHERE ok) / count(*) AS acc FROM samples GROUP BY parser, s)
           GROUP BY parser""",
        samples=SQL_SAMPLES,
    ),
)
def within_arm_sd(spark, sf):
    return stats.within_arm_sd(samples(spark, sf)).withColumns(R6("mean_acc", "sd_acc"))


@query(
    "B11_review_curve",
    with_relations(
        "fields",
        """SELECT parser, round(agreement, 6) AS threshold, CAST(nk AS BIGINT) AS n_kept,
             round((na - nk) / na, 6) AS review_rate, round(wk / nk, 6) AS residual_error
           FROM (SELECT *, sum(n) OVER o AS nk, sum(w) OVER o AS wk,
               sum(n) OVER (PARTITION BY parser) AS na
             FROM (SELECT parser, agreement, count(*) AS n, count(*) FILTER (WHERE NOT modal_ok)
               AS w FROM agreed GROUP BY parser, agreement)
             WINDOW o AS (PARTITION BY parser ORDER BY agreement DESC))""",
        samples=SQL_SAMPLES, agreed=SQL_AGREEMENT,
    ),
)
def review_curve(spark, sf):
    return stats.review_curve(stats.sample_agreement(samples(spark, sf))).withColumns(
        R6("threshold", "review_rate", "residual_error")
    )


DIRECT_PAIRS = [(SYSTEMS[i], SYSTEMS[j]) for i in range(3) for j in range(3, 6)]
SQL_DIRECT_PAIRS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, b in DIRECT_PAIRS
) + ") v(a, b)"


@query(
    "B12_permutation_holm",
    with_relations(
        "fields",
        f"""SELECT a, b, observed, n_docs, n_moved, round(p, 6) AS p, round(least(1, max(s) OVER
             (ORDER BY p, a, b)), 6) AS p_holm FROM (
           SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p AS s FROM (
           SELECT o.*, (coalesce(extreme, {ITERS}) + 1) / ({ITERS} + 1) AS p FROM observed o
           LEFT JOIN (SELECT a, b, count(*) FILTER (WHERE abs(s) >= abs(obs)) AS extreme FROM (
             SELECT a, b, it, any_value(obs) AS obs,
               sum(CASE WHEN h & 65536 = 0 THEN d ELSE -d END) AS s FROM flips GROUP BY a, b, it)
             GROUP BY a, b) x ON x.a = o.a AND x.b = o.b))""",
        **sql_pairs(CHECKBOX_DOCS, SQL_DIRECT_PAIRS),
        observed="""SELECT a, b, CAST(sum(ca - cb) AS BIGINT) AS observed, count(*) AS n_docs,
          count(*) FILTER (WHERE ca <> cb) AS n_moved FROM paired GROUP BY a, b""",
        slots=f"""SELECT p.a, p.b, o.observed AS obs, ca - cb AS d, {HASH.format('doc')} AS t,
          {HASH2.format('doc')} AS t2, unnest(range(0, {ITERS})) AS it FROM paired p JOIN observed o ON o.a = p.a AND o.b = p.b
          WHERE ca <> cb""",
        flips=sql_draws("slots", "(it + t2)", "t", "a, b, obs, d, it"),
    ),
)
def permutation_holm(spark, sf):
    pairs = spark.createDataFrame(DIRECT_PAIRS, "a string, b string")
    tests = stats.permutation_test(boolean_outcomes(spark, sf), pairs)
    return stats.holm(tests).withColumns(R6("p", "p_holm"))


@query(
    "B12_random_effects",
    with_relations(
        "fields",
        """SELECT domain, count(*) AS k, round(sum(v * delta) / sum(v), 6) AS mean,
             round(1 / sqrt(sum(v)), 6) AS se, round(max(q), 6) AS q, round(max(tau2), 6) AS tau2
           FROM (SELECT *, 1 / (var + tau2) AS v FROM (
             SELECT *, greatest(0, coalesce((q - (k - 1)) / nullif(sw - sww / sw, 0), 0)) AS tau2
             FROM (SELECT *, sum(w * pow(delta - mean, 2)) OVER d AS q FROM (
               SELECT *, sum(w) OVER d AS sw, sum(w * w) OVER d AS sww, count(*) OVER d AS k,
                 sum(w * delta) OVER d / sum(w) OVER d AS mean
               FROM (SELECT *, 1 / var AS w FROM deltas) WINDOW d AS (PARTITION BY domain))
               WINDOW d AS (PARTITION BY domain))))
           GROUP BY domain""",
        deltas="""SELECT x.domain, x.p, x.acc - y.acc AS delta, x.acc * (1 - x.acc) / x.n
            + y.acc * (1 - y.acc) / y.n AS var
          FROM (SELECT domain, p, count(*) AS n,
                  count(*) FILTER (WHERE status = 'correct') / count(*) AS acc
                FROM fields WHERE p < 3 GROUP BY domain, p) x
          JOIN (SELECT domain, p, count(*) AS n,
                  count(*) FILTER (WHERE status = 'correct') / count(*) AS acc
                FROM fields WHERE p >= 3 GROUP BY domain, p) y
          ON x.domain = y.domain AND y.p = x.p + 3""",
    ),
)
def random_effects(spark, sf):
    acc = outcomes(spark, sf).groupBy("domain", "parser").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("status") == "correct", 1.0).otherwise(0.0)).alias("acc"),
    ).withColumn("var", F.col("acc") * (1 - F.col("acc")) / F.col("n"))
    pairs = spark.createDataFrame(
        [(SYSTEMS[i], SYSTEMS[i + 3]) for i in range(3)], "a string, b string"
    )
    a = acc.select("domain", F.col("parser").alias("a"), F.col("acc").alias("x"),
                   F.col("var").alias("vx"))
    b = acc.select("domain", F.col("parser").alias("b"), F.col("acc").alias("y"),
                   F.col("var").alias("vy"))
    deltas = a.join(pairs, "a").join(b, ["domain", "b"]).select(
        "domain", (F.col("x") - F.col("y")).alias("delta"), (F.col("vx") + F.col("vy")).alias("var")
    )
    return stats.random_effects(deltas, ["domain"]).withColumns(R6("mean", "se", "q", "tau2"))


@query(
    "A17_breakdown_ci",
    with_relations(
        "fields",
        f"""SELECT p.*, lo, hi FROM
             (SELECT parser, domain, round(sum(c) / sum(n), 6) AS acc, CAST(sum(n) AS BIGINT) AS n,
                count(*) AS n_docs FROM docs GROUP BY parser, domain) p
           JOIN (SELECT parser, domain, round(quantile_cont({share_sql('c', 'n')}, 0.025), 6) AS lo,
                round(quantile_cont({share_sql('c', 'n')}, 0.975), 6) AS hi
                FROM stats GROUP BY parser, domain) s USING (parser, domain)""",
        docs="""SELECT parser, domain, doc, count(*) AS n,
          count(*) FILTER (WHERE status = 'correct') AS c FROM fields GROUP BY 1, 2, 3""",
        **sql_resample("docs", "parser, domain", ["n", "c"]),
    ),
)
def breakdown_ci(spark, sf):
    return stats.cluster_bootstrap_ci(outcomes(spark, sf), ["domain"]).withColumns(R6("acc", "lo", "hi"))


@query(
    "B03_separable",
    with_relations(
        "fields",
        f"SELECT a, b, lo > 0 OR hi < 0 AS separable FROM ({SQL_DELTA})",
        **sql_pairs(
            CHECKBOX_DOCS,
            "SELECT * FROM (VALUES " + ", ".join(f"('{SYSTEMS[0]}', '{x}')" for x in SYSTEMS[1:]) + ") v(a, b)",
        ),
        **sql_resample("legs_docs", "parser", ["n", "c"]),
    ),
)
def separable(spark, sf):
    """Which legs' checkbox accuracy differs from the first leg's, by sign of the interval."""
    pairs = spark.createDataFrame([(SYSTEMS[0], s) for s in SYSTEMS[1:]], "a string, b string")
    ci = stats.paired_delta_ci(boolean_outcomes(spark, sf), pairs)
    return ci.select("a", "b", stats.separable(F.round("lo", 6), F.round("hi", 6)).alias("separable"))
