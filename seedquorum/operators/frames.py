"""Report tables: joins and pivots of the summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.functions import scalar as S
from seedquorum.operators import relational as R
from seedquorum.operators.agreement import UNIT


def unit_table(units: DataFrame, iso: DataFrame, threshold: float = S.PRIMARY_ISO) -> DataFrame:
    """A unit's scores beside its iso-accuracy pairs at one threshold; one-to-one."""
    i = iso.where(S.close(F.col("threshold"), threshold)).drop("threshold")
    return R.join_one_to_one(units, i, list(UNIT))


def ranking_table(ranks: DataFrame, correlations: DataFrame, tertiles: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """Rank summary, within-unit correlation, medians by third (a column each) and, if given, consensus gain; tables one-to-one."""
    t = R.pivot(tertiles.select(*UNIT, "tertile", "median_value"), list(UNIT), "tertile", ["Low", "Middle", "High"], ["median_value"])
    more = [gains.select(*UNIT, "split_half_ari", "gain")] if gains is not None else []
    return R.chain([ranks, correlations.select(*UNIT, "spearman"), t, *more], list(UNIT))


def frequent_genes(frequency: DataFrame, top: int = 18, domains: list | None = None) -> DataFrame:
    """The genes of highest mean frequency (absent domains don't count; ties by gene), one column per domain."""
    mean = frequency.groupBy(*UNIT, "gene").agg(F.round(F.avg("frequency"), 9).alias("mean_frequency"))
    best = R.top_per_group(mean, list(UNIT), [F.desc("mean_frequency"), "gene"], top)
    f = frequency.join(best, [*UNIT, "gene"]).withColumn("domain", F.concat(F.lit("d"), F.col("domain").cast("string")))
    return R.pivot(f, [*UNIT, "gene", "rank", "mean_frequency"], "domain", domains or [f"d{k}" for k in range(5)], ["frequency"])


def stable_unstable(controls: DataFrame, metrics: DataFrame, families: DataFrame, gap: float = 0.10, least: int = 2) -> DataFrame:
    """Medians of a metric over the unstable and the stable pairs of each family (dataset -> family), the gap, and whether at least
    ``least`` families have one of ``gap``. ``metrics``: dataset, method, seed_r, seed_s, value.
    """
    side = lambda s: metrics.select(*UNIT, F.col("seed_r").alias(f"{s}_r"), F.col("seed_s").alias(f"{s}_s"), F.col("value").alias(s))
    both = controls.join(side("unstable"), [*UNIT, "unstable_r", "unstable_s"]).join(side("stable"), [*UNIT, "stable_r", "stable_s"]).join(families, "dataset")
    m = both.groupBy("family").agg(F.count("*").alias("n"), F.median("unstable").alias("unstable_median"), F.median("stable").alias("stable_median"))
    m = m.withColumn("gap", F.col("stable_median") - F.col("unstable_median"))
    hit = m.agg((F.count_if(F.col("gap") >= gap) >= least).alias("triggered"))
    return m.crossJoin(hit)  # a row per family by one row


def set_jaccard(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key of either side: shared and all items of two sets, and their Jaccard index; no item on either side is NULL."""
    l, r = left.select(*keys, item).distinct().withColumn("l", F.lit(1)), right.select(*keys, item).distinct().withColumn("r", F.lit(1))
    both = l.join(r, [*keys, item], "full_outer")
    return both.groupBy(*keys).agg(F.count(F.expr("l + r")).alias("shared"), F.count("*").alias("all_items"), F.try_divide(F.count(F.expr("l + r")).cast("double"), F.count("*")).alias("jaccard"))


def landscape(datasets: DataFrame, methods: list[str], runs_per_method: int, display: dict[str, str]) -> DataFrame:
    """A dimension of datasets with the study's constants: all methods joined by ';', runs of a dataset, and the names for display (own name if none)."""
    out = R.map_column(datasets, "dataset", "dataset_display", display, F.col("dataset"))
    return out.withColumns({"methods": F.lit(";".join(methods)), "valid_runs": F.lit(runs_per_method * len(methods))})


def noted(df: DataFrame, rules: list[tuple[Column, str, Column | str]]) -> DataFrame:
    """Texts replaced where a condition holds; rules go one after another, so later ones see what earlier ones wrote."""
    for condition, column, text in rules:
        df = df.withColumn(column, F.when(F.coalesce(condition, F.lit(False)), text if isinstance(text, Column) else F.lit(text)).otherwise(F.col(column)))
    return df


def map_union(frames: list[tuple[DataFrame, dict[str, str]]], columns: list[str]) -> DataFrame:
    """Spatial maps of several vocabularies under one: each with its renames, in the wanted columns; a missing one is an error."""
    return reduce(DataFrame.unionByName, (df.withColumnsRenamed(names).select(*columns) for df, names in frames))


def control_table(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Controls in display order: each part (method, dataset, control, ari, nmi) with its type; absent values are NULL.

    The order is that of parts, then method, dataset and control; a few rows a method.
    """
    kinds = {"method": "string", "dataset": "string", "control": "string", "ari": "double", "nmi": "double"}
    rows = [df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()), F.lit(t).alias("control_type"), F.lit(i).alias("part")) for i, (df, t) in enumerate(parts)]
    every = reduce(DataFrame.unionByName, rows)
    return every.select(F.row_number().over(Window.orderBy("part", "method", "dataset", "control")).alias("display_order"), *kinds, "control_type")


def scope(seeds: DataFrame, context: Column) -> DataFrame:
    """Per context of datasets: datasets, units and runs; and one row of all, whose context is TOTAL."""
    counts = [F.countDistinct("dataset").alias("datasets"), F.countDistinct(*UNIT).alias("units"), F.count("*").alias("runs")]
    rows = seeds.withColumn("context", context)
    return rows.groupBy("context").agg(*counts).unionByName(rows.agg(*counts).withColumn("context", F.lit("TOTAL")))
