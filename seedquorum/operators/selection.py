"""Exact quantiles and midranks whose state in a task doesn't grow with a group.

Quantiles: a histogram over bins of equal ratio (the same for every group, so no group's range is needed first) is summed in the tasks that
read the values. Only the bins that hold wanted ranks are looked at again, in finer bins between their least and greatest value,
until such a bin is one value, or holds few rows. Five rounds tell any two doubles apart.

Midranks: rows are counted by value, so ties are one row; the counts are range-partitioned by key and value, so a group lies over several partitions;
each partition sums up its own, and partitions' totals, a row for each key in it, are carried to the next ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.functions import scalar as S
from seedquorum.plans.workspace import Workspace

#: Bins of a factor e in the first round (a bin is about 2 per cent wide); bins of an interval in later ones.
RATIO_BINS, BINS = 46, 4096
#: An interval of at most so many rows is sorted as it is.
FEW = 1024
#: Intervals that are broadcast; of more, a join that Spark may split.
BROADCAST_INTERVALS = 100_000


def _ratio_bin(v: Column) -> Column:
    """Never falls as v rises; over all doubles below 73,000 either way."""
    at = F.floor(F.log(F.abs(v)) * RATIO_BINS).cast("int") + 40_000
    return F.when(v > 0, at).when(v < 0, -at).otherwise(0)


def _equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def quantiles(rows: DataFrame, keys: list[str], wanted: Mapping[str, tuple[str, float]], work: Workspace | None = None) -> DataFrame:
    """keys, and a column per entry of ``wanted``: name -> (value column, p), the linear quantile of its finite values; NULL without any.

    Every group of ``rows`` has a row; null keys are groups. ``n__<column>`` are the finite values of each column.
    """
    work = work or Workspace(rows.sparkSession, "quantiles")
    columns = sorted({c for c, _ in wanted.values()})
    ids = [f"k{i}" for i in range(len(keys))]
    parts = F.array(*(F.struct(F.lit(i).alias("c"), S.finite_or_null(F.col(c).cast("double")).alias("v")) for i, c in enumerate(columns)))
    flat = rows.select(*(F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)), F.explode(parts).alias("x")).select(*ids, "x.c", "x.v")
    group = [*ids, "c"]
    bins = work.write(flat.groupBy(*group, F.when(F.col("v").isNotNull(), _ratio_bin(F.col("v"))).alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "bins")
    total = bins.groupBy(*group).agg(F.sum("n").alias("total"))
    ask = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(columns.index(c)).alias("c"), F.lit(float(p)).alias("p")) for name, (c, p) in wanted.items()))
    asked = total.select("*", F.explode(F.filter(ask, lambda a: a["c"] == F.col("c"))).alias("a")).where("total > 0").select(*group, F.col("a.name").alias("name"), (F.col("a.p") * (F.col("total") - 1)).alias("at"))
    asked = work.write(asked.select("*", F.floor("at").alias("low"), F.ceil("at").alias("high")), "asked")
    ranks = asked.select(*group, F.explode(F.array_distinct(F.array("low", "high"))).alias("rank")).distinct()

    def holding(histogram: DataFrame, over: list[str], open_ranks: DataFrame, name: str) -> DataFrame:
        """The bins that hold ranks, which count from the start of ``over``."""
        sums = histogram.where("n > 0").withColumn("before", F.sum("n").over(Window.partitionBy(*over).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        hit = sums.alias("s").join(open_ranks.alias("r"), reduce(lambda a, b: a & b, (F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in over)))
        hit = hit.where("r.rank >= s.before AND r.rank < s.before + s.n")
        return work.write(hit.select(*(F.col(f"s.{k}").alias(k) for k in group), "r.wanted", "s.bin", "s.lo", "s.hi", "s.n", (F.col("r.rank") - F.col("s.before")).alias("rank")), name)

    found = []
    held = holding(bins, group, ranks.withColumn("wanted", F.col("rank")), "held")
    values = None
    for round_ in range(8):
        found.append(held.where("lo = hi").select(*group, F.col("wanted").alias("rank"), F.col("lo").alias("v")))
        left = held.where("lo < hi")
        intervals = work.write(left.select(*group, "bin", "lo", "hi", "n").distinct(), f"open{round_}")
        n_open, most = intervals.agg(F.count("*"), F.max("n")).first()
        if not n_open:
            break
        near = F.broadcast(intervals) if n_open <= BROADCAST_INTERVALS else intervals
        source = (flat.where("v IS NOT NULL").withColumn("bin", _ratio_bin(F.col("v"))) if values is None else values).alias("f")
        on = reduce(lambda a, b: a & b, (F.col(f"f.{k}").eqNullSafe(F.col(f"i.{k}")) for k in [*group, "bin"]))
        inside = source.join(near.alias("i"), on & F.expr("f.v BETWEEN i.lo AND i.hi"))
        values = work.write(inside.select(*(F.col(f"f.{k}").alias(k) for k in [*group, "bin"]), "f.v", F.col("i.lo").alias("from"), F.col("i.hi").alias("to")), f"values{round_}")
        if most <= FEW:
            place = Window.partitionBy(*group, "bin", "from").orderBy("v")
            placed = values.withColumn("place", F.row_number().over(place) - 1).alias("p")
            on = reduce(lambda a, b: a & b, (F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*group, "bin"]))
            found.append(placed.join(left.alias("h"), on & F.expr("p.`from` = h.lo AND p.place = h.rank")).select(*(F.col(f"p.{k}").alias(k) for k in group), F.col("h.wanted").alias("rank"), "p.v"))
            break
        sub = F.least(F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * BINS), F.lit(BINS - 1)).cast("int")
        finer = values.groupBy(*group, "bin", "from", sub.alias("sub")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        held = holding(finer, [*group, "bin", "from"], left.select(*group, "bin", F.col("lo").alias("from"), "wanted", "rank"), f"held{round_}")
        values = values.drop("from", "to")
    got = work.write(reduce(DataFrame.unionByName, found), "found")

    out = asked
    for side in ("low", "high"):
        on = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in group), F.col(f"o.{side}") == F.col("g.rank"))
        out = out.alias("o").join(got.alias("g"), on).select("o.*", F.col("g.v").alias(f"v_{side}"))
    share = F.col("at") - F.col("low")
    value = F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise((1 - share) * F.col("v_low") + share * F.col("v_high"))
    one = out.select(*ids, "name", value.alias("value")).groupBy(*ids).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(f"q{i}") for i, name in enumerate(wanted)))
    every = total.groupBy(*ids).agg(*(F.max(F.when(F.col("c") == i, F.col("total"))).alias(f"n{i}") for i in range(len(columns))))
    both = every.alias("e").join(one.alias("o"), reduce(lambda a, b: a & b, (F.col(f"e.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ids)) if ids else F.lit(True), "left")  # without keys, one row by one row
    return both.select(*(F.col(f"e.{i}").alias(k) for k, i in zip(keys, ids, strict=True)), *(F.col(f"n{i}").alias(f"n__{c}") for i, c in enumerate(columns)), *(F.col(f"q{i}").alias(name) for i, name in enumerate(wanted)))


def value_ranks(rows: DataFrame, keys: list[str], value: str, work: Workspace) -> DataFrame:
    """keys, value, n, rank: each distinct value that isn't null, its rows and their average rank within the keys. Null keys are groups."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = work.write(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "counts")
    upto = Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.groupBy("_part", *keys).agg(F.sum("_n").alias("_t"))  # a row for each key of a partition
    carried = carried.select("_part", *keys, (F.sum("_t").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_t")).alias("_before"))
    inner = placed.withColumn("_own", F.sum("_n").over(upto) - F.col("_n")).alias("p")
    both = inner.join(carried.alias("c"), reduce(lambda a, b: a & b, (F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ["_part", *keys])))
    return both.select(*(F.col(f"p.{k}").alias(k) for k in [*keys, value]), F.col("p._n").alias("n"), (F.col("c._before") + F.col("p._own") + (F.col("p._n") + 1) / F.lit(2.0)).alias("rank"))


def midranks(rows: DataFrame, keys: list[str], value: str, name: str = "rank", work: Workspace | None = None) -> DataFrame:
    """``rows`` with the average rank of each value within its keys; a null value's is null."""
    work = work or Workspace(rows.sparkSession, "midranks")
    ranks = work.write(value_ranks(rows, keys, value, work), f"ranks_{name}").alias("r")
    on = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys), F.col(f"l.{value}") == F.col(f"r.{value}"))
    return rows.alias("l").join(ranks, on, "left").select("l.*", F.col("r.rank").alias(name))
