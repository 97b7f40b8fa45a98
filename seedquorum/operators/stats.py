"""Rank statistics and distribution summaries."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seedquorum.functions import scalar as S
from seedquorum.operators.selection import midranks, quantiles, value_ranks
from seedquorum.plans.workspace import Workspace


def _exact_tail(n: int, w: float) -> float:
    """P(W+ >= w) without ties: counts of subsets of 1..n by sum."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for s in range(len(counts) - 1, k - 1, -1):
            counts[s] += counts[s - k]
    return sum(counts[math.ceil(w) :]) / 2**n


@F.pandas_udf(DoubleType())
def signed_rank_p(n: pd.Series, w: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
    """One-sided p; exact for up to 50 differences without ties and zeros, else normal without continuity correction."""
    return pd.Series([None if a is None or a == 0 or math.isnan(a) else _exact_tail(int(a), b) if e else 0.5 * math.erfc(c / math.sqrt(2)) for a, b, c, e in zip(n, w, z, exact, strict=True)], dtype="float64")


def signed_rank(rows: DataFrame, greater: str, less: str, keys: list[str] | None = None, p_value: bool = True) -> DataFrame:
    """Paired one-sided signed-rank test, zeros dropped, and the matched rank-biserial correlation."""
    keys = keys or []
    d = rows.select(*keys, S.finite_or_null(F.col(greater) - F.col(less)).alias("d")).where("d IS NOT NULL")
    zeros = d.groupBy(*keys).agg(F.count_if(F.expr("d = 0")).alias("n_zero"), F.count("*").alias("n_pairs"))
    work = Workspace(rows.sparkSession, "signed_rank")
    m = work.write(d.where("d <> 0").withColumn("m", F.abs("d")), "differences")
    ranks = value_ranks(m, keys, "m", work).alias("r")
    signs = m.groupBy(*keys, "m").agg(F.count_if(F.expr("d > 0")).alias("plus"), F.count_if(F.expr("d < 0")).alias("minus")).alias("s")
    on = reduce(lambda a, b: a & b, (F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "m"]))
    r = signs.join(ranks, on).select(*(F.col(f"s.{k}").alias(k) for k in keys), "s.plus", "s.minus", "r.n", "r.rank")
    s = r.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.expr("plus * rank")).alias("w_plus"), F.sum(F.expr("minus * rank")).alias("w_minus"), F.sum(F.expr("cast(n AS double) * (n * n - 1)")).alias("ties"))
    z = "try_divide(w_plus - n * (n + 1) / 4D, sqrt(n * (n + 1) * (2 * n + 1) / 24D - ties / 48D))"
    s = s.select(*keys, "n", "w_plus", "w_minus", F.expr(z).alias("z"), F.expr("try_divide(w_plus - w_minus, w_plus + w_minus)").alias("rank_biserial"), F.col("ties"))
    out = s.join(zeros, keys) if keys else s.crossJoin(zeros)  # one row each
    if p_value:
        out = out.withColumn("p", signed_rank_p(F.col("n").cast("double"), "w_plus", "z", F.expr("n <= 50 AND ties = 0D AND n_zero = 0")))
    return out.drop("ties")


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per key over complete pairs; NULL with fewer than two or a constant side."""
    work = Workspace(rows.sparkSession, "spearman")
    full = work.write(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), "pairs")
    r = midranks(midranks(full, keys, "_x", "_rx", work), keys, "_y", "_ry", work)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), S.correlation("_rx", "_ry").alias("spearman"))


def finite_summary(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, median and quartiles of the finite values."""
    q = quantiles(rows, keys or [], {"median": (value, 0.5), "q25": (value, 0.25), "q75": (value, 0.75)})
    return q.withColumnRenamed(f"n__{value}", "n")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; the top edge belongs to the last bin, values outside don't count."""
    v = F.col(value)
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.where(S.finite(v) & v.between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts, nulls as a group of their own."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def tertiles(rows: DataFrame, keys: list[str], value: str, ties: list[str], names: tuple[str, ...] = ("Low", "Middle", "High")) -> DataFrame:
    """``rows`` with their third of the partition by value, then by the ties' order."""
    t = F.ntile(len(names)).over(Window.partitionBy(*keys).orderBy(value, *ties))
    return rows.withColumn("tertile", F.element_at(F.array(*map(F.lit, names)), t))


def entropy(rows: DataFrame, keys: list[str], p: str) -> DataFrame:
    return rows.groupBy(*keys).agg(S.entropy_bits(p).alias("entropy_bits"))


def cumulative(rows: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Running counts by value, and whether a value is the integer median (the first to reach half)."""
    w = Window.partitionBy(*keys)
    out = rows.withColumns({"cumulative": F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(count).over(w)})
    return out.withColumn("is_median", (F.col("cumulative") >= F.ceil(F.col("total") / 2)) & (F.col("cumulative") - F.col(count) < F.ceil(F.col("total") / 2)))
