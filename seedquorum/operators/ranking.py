"""Ranking methods over the exact product of their seed scores.

The product space (20**5 combinations a dataset) is never listed. For a method's score f every other method contributes a factor
gt*x + eq*y + lt; the coefficient of x**a y**b in their product counts the combinations with a methods above and b tied, so
midranks and shared first places follow in integers.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.functions import scalar as S


def _product_states(scores: DataFrame, m: int) -> DataFrame:
    """dataset, method, a, b, combos: summed over the method's own scores."""
    own = scores.select("dataset", "method", "seed", F.col("ari").alias("f"))
    other = scores.select("dataset", F.col("method").alias("other"), F.col("ari").alias("g"))
    faced = own.join(other, "dataset").where("method <> other").groupBy("dataset", "method", "seed", "other")
    faced = faced.agg(F.count_if(F.expr("g > f")).alias("gt"), F.count_if(F.expr("g = f")).alias("eq"), F.count_if(F.expr("g < f")).alias("lt"))
    faced = faced.groupBy("dataset", "method", "seed").agg(F.collect_list(F.struct("gt", "eq", "lt")).alias("o"))
    at = lambda i: f"(CASE WHEN {i} >= 0 THEN c[{i}] ELSE 0L END)"
    step = f"transform(c, (v, i) -> v * t.lt + (CASE WHEN i >= {m} THEN c[i - {m}] * t.gt ELSE 0L END) + (CASE WHEN i % {m} > 0 THEN c[i - 1] * t.eq ELSE 0L END))"
    start = f"transform(sequence(0, {m * m - 1}), i -> CASE WHEN i = 0 THEN 1L ELSE 0L END)"
    folded = faced.select("dataset", "method", F.posexplode(F.expr(f"aggregate(o, {start}, (c, t) -> {step})")).alias("i", "c")).where("c > 0")
    return folded.groupBy("dataset", "method", F.expr(f"cast(i div {m} AS int)").alias("a"), F.expr(f"cast(i % {m} AS int)").alias("b")).agg(F.sum("c").alias("combos"))


def rank_distribution(scores: DataFrame, m: int = 5, observed_only: bool = False) -> DataFrame:
    """dataset, method, rank_x2 (twice the midrank), combos. All ranks 2..2m are listed unless ``observed_only``."""
    s = _product_states(scores, m).groupBy("dataset", "method", F.expr("2 + 2 * a + b").alias("rank_x2")).agg(F.sum("combos").alias("combos"))
    if observed_only:
        return s
    grid = scores.select("dataset", "method").distinct().select("*", F.explode(F.sequence(F.lit(2), F.lit(2 * m))).alias("rank_x2"))
    return grid.join(s, ["dataset", "method", "rank_x2"], "left").select("dataset", "method", "rank_x2", F.coalesce("combos", F.lit(0)).cast("long").alias("combos"))


def winner_probability(scores: DataFrame, m: int = 5) -> DataFrame:
    """Shared first places: credit scaled by lcm(1..m), and the probability."""
    scale = lcm(*range(1, m + 1))
    s = _product_states(scores, m)
    out = s.groupBy("dataset", "method").agg(F.sum(F.expr(f"CASE WHEN a = 0 THEN combos * {scale}L div (b + 1) ELSE 0L END")).alias("credit"), F.sum("combos").alias("combos"))
    return out.select("dataset", "method", "credit", (F.col("combos") * scale).alias("credit_denominator"), (F.col("credit").cast("double") / (F.col("combos") * scale)).alias("p_rank1"))


def rank_summary(scores: DataFrame, m: int = 5) -> DataFrame:
    d = rank_distribution(scores, m)
    running = Window.partitionBy("dataset", "method").orderBy("rank_x2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"cum": F.sum("combos").over(running), "n": F.sum("combos").over(Window.partitionBy("dataset", "method"))})
    n = F.max("n").cast("double")
    out = d.groupBy("dataset", "method").agg(
        F.max("n").alias("combos"),
        (F.sum(F.expr("combos * rank_x2")).cast("double") / 2 / n).alias("expected_rank"),
        (F.min(F.expr("CASE WHEN cum >= ceil(n / 2D) THEN rank_x2 END")) / F.lit(2.0)).alias("median_rank"),
        (F.sum(F.expr("CASE WHEN rank_x2 <= 4 THEN combos ELSE 0L END")).cast("double") / n).alias("p_top2"),
        (F.sum(F.expr("CASE WHEN rank_x2 <= 6 THEN combos ELSE 0L END")).cast("double") / n).alias("p_top3"),
    )
    return out.join(winner_probability(scores, m).select("dataset", "method", "p_rank1"), ["dataset", "method"])


def winner_uncertainty(scores: DataFrame, methods: DataFrame, m: int = 5) -> DataFrame:
    """Per dataset: largest p, all winners in method order joined by ';', counts of p > 0 and p >= 0.05, entropy in bits."""
    p = winner_probability(scores, m).join(methods, "method")
    top = Window.partitionBy("dataset")
    p = p.withColumn("best", F.max("credit").over(top))
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("credit") == F.col("best"), F.struct("ord", "method")))), lambda x: x["method"]), ";")
    return p.groupBy("dataset").agg(
        F.sum("credit").alias("credit_sum"), F.max("p_rank1").alias("max_p_rank1"), names.alias("most_probable_winner"), F.count_if(F.col("p_rank1") > 0).alias("n_positive"), F.count_if(F.col("p_rank1") >= 0.05).alias("n_at_least_5_percent"),
        S.entropy_bits("p_rank1").alias("entropy_bits"), (S.entropy_bits("p_rank1") / F.log2(F.lit(float(m)))).alias("entropy_normalized"),
    )


def pairwise_superiority(scores: DataFrame, methods: DataFrame, seeds: int = 20, m: int = 5) -> DataFrame:
    """Method pairs in method order over all seed pairs, and the counts' expansion to the full product."""
    s = scores.join(methods, "method").select("dataset", "method", "ord", "ari")
    a, b = s.select("dataset", F.col("method").alias("method_a"), F.col("ord").alias("oa"), F.col("ari").alias("x")), s.select("dataset", F.col("method").alias("method_b"), F.col("ord").alias("ob"), F.col("ari").alias("y"))
    c = a.join(b, "dataset").where("oa < ob").groupBy("dataset", "method_a", "method_b").agg(F.count_if(F.expr("x > y")).alias("a_gt_b"), F.count_if(F.expr("y > x")).alias("b_gt_a"), F.count_if(F.expr("x = y")).alias("ties"), F.count("*").alias("n"))
    rest = seeds ** (m - 2)
    return c.select("dataset", "method_a", "method_b", "a_gt_b", "b_gt_a", "ties", *((F.col(x) * rest).alias(f"{x}_expanded") for x in ("a_gt_b", "b_gt_a", "ties")), (F.col("a_gt_b").cast("double") / F.col("n")).alias("p_a_gt_b"), (F.col("b_gt_a").cast("double") / F.col("n")).alias("p_b_gt_a"), (F.col("ties").cast("double") / F.col("n")).alias("p_tie"))


def lowest_certainty(uncertainty: DataFrame, n: int = 3) -> DataFrame:
    """The n datasets whose most probable winner is least probable."""
    return uncertainty.orderBy("max_p_rank1", "dataset").limit(n)


def matched_ranks(scores: DataFrame) -> DataFrame:
    """Competition rank (ties take the best) of methods that share a seed."""
    return scores.select("dataset", "method", "seed", "ari", F.rank().over(Window.partitionBy("dataset", "seed").orderBy(F.desc("ari"))).alias("rank"))


def matched_rank_summary(scores: DataFrame, methods: DataFrame) -> DataFrame:
    r = matched_ranks(scores)
    w = r.where("rank = 1").join(methods, "method").groupBy("dataset", "seed").agg(F.min_by("method", "ord").alias("winner"))
    first = w.where("seed = 1").select("dataset", F.col("winner").alias("first_winner"))
    change = w.join(first, "dataset").groupBy("dataset").agg(F.avg(F.expr("cast(winner <> first_winner AS double)")).alias("winner_change_frequency"), F.countDistinct("winner").alias("n_winners"))
    med = scores.groupBy("dataset", "method").agg(F.median("ari").alias("median_ari"))
    med = med.select("dataset", "method", F.rank().over(Window.partitionBy("dataset").orderBy(F.desc("median_ari"))).alias("median_ari_rank"))
    top = {f"top{k}_frequency": F.avg((F.col("rank") <= k).cast("double")) for k in (1, 2, 3)}
    out = r.groupBy("dataset", "method").agg(F.median("rank").alias("median_rank"), F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), *(c.alias(n) for n, c in top.items()), F.max(F.when(F.col("seed") == 1, F.col("rank"))).alias("seed1_rank"))
    return out.join(med, ["dataset", "method"]).join(change, "dataset")
