"""Summaries of seeds and seed pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.functions import scalar as S
from seedquorum.operators.agreement import UNIT
from seedquorum.operators.selection import quantiles
from seedquorum.operators.stats import spearman


def quantile(x: str, p: float):
    """Exact linear quantile; null and non-finite values don't count."""
    return F.percentile(S.finite_or_null(F.col(x)), p)


def unit_summary(accuracy: DataFrame, pairs: DataFrame) -> DataFrame:
    a = accuracy.groupBy(*UNIT).agg(
        F.count("*").alias("n_seeds"),
        F.median("ari").alias("median_reference_ari"),
        F.stddev_samp("ari").alias("reference_ari_sd"),
        F.min("ari").alias("reference_ari_min"),
        F.max("ari").alias("reference_ari_max"),
        (F.max("ari") - F.min("ari")).alias("reference_ari_range"),
        F.median("nmi").alias("median_reference_nmi"),
        F.stddev_samp("nmi").alias("reference_nmi_sd"),
    )
    p = pairs.groupBy(*UNIT).agg(
        F.median("ari").alias("median_pair_ari"),
        quantile("ari", 0.05).alias("p05_pair_ari"),
        F.min("ari").alias("min_pair_ari"),
        F.median("nmi").alias("median_pair_nmi"),
        quantile("nmi", 0.05).alias("p05_pair_nmi"),
        F.min("nmi").alias("min_pair_nmi"),
    )
    out = a.join(p, list(UNIT), "left").withColumn("instability", 1 - F.col("median_pair_ari"))
    flag = (F.col("reference_ari_sd") <= S.LOW_SD + S.EPS) & (F.col("instability") >= S.HIGH_INSTABILITY - S.EPS)
    return out.withColumn("low_sd_high_instability", F.coalesce(flag, F.lit(False)))


def section_summary(units: DataFrame) -> DataFrame:
    return units.groupBy("dataset").agg(
        F.count("*").alias("n_methods"), F.median("median_reference_ari").alias("median_reference_ari"), F.median("reference_ari_sd").alias("median_reference_ari_sd"), F.median("median_pair_ari").alias("median_pair_ari"), F.median("instability").alias("median_instability")
    )


def iso_summary(pairs: DataFrame, units: DataFrame, thresholds: tuple[float, ...] = S.ISO_THRESHOLDS, epsilon: float = S.EPS) -> DataFrame:
    """Per unit and threshold; units without an iso-accuracy pair stay, with null statistics."""
    grid = units.select(*UNIT, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = S.iso_accuracy(F.col("ari_r"), F.col("ari_s"), F.col("threshold"), epsilon)
    rows = pairs.select(*UNIT, "ari_r", "ari_s", "partition_ari", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where(hit)
    got = rows.groupBy(*UNIT, "threshold").agg(F.count("*").alias("n"), F.median("partition_ari").alias("median_partition_ari"), F.min("partition_ari").alias("min_partition_ari"), F.count_if(S.divergent(F.col("partition_ari"))).alias("d"))
    out = grid.join(got, [*UNIT, "threshold"], "left")
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
    return out.select(*UNIT, "threshold", n.alias("n_iso_pairs"), "median_partition_ari", "min_partition_ari", d.alias("n_divergent"), S.masked_divide(d.cast("double"), n.cast("double")).alias("divergent_fraction"), (d > 0).alias("contains_divergent"))


def threshold_sensitivity(pairs: DataFrame, thresholds: tuple[float, ...] = S.ISO_THRESHOLDS) -> DataFrame:
    rows = pairs.select("ari_r", "ari_s", "partition_ari", *UNIT, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    rows = rows.where(S.iso_accuracy(F.col("ari_r"), F.col("ari_s"), F.col("threshold")))
    pooled = quantiles(rows, ["threshold"], {"pooled_median_partition_ari": ("partition_ari", 0.5)}).drop("n__partition_ari")  # over all units
    out = rows.groupBy("threshold").agg(
        F.countDistinct(*UNIT).alias("n_units"),
        F.count("*").alias("n_iso_pairs"),
        F.count_if(S.divergent(F.col("partition_ari"))).alias("n_divergent"),
        F.avg(S.divergent(F.col("partition_ari")).cast("double")).alias("divergent_fraction"),
    )
    return out.join(pooled, "threshold")


def iso_pairs(pairs: DataFrame, threshold: float = S.PRIMARY_ISO) -> DataFrame:
    return pairs.where(S.iso_accuracy(F.col("ari_r"), F.col("ari_s"), threshold))


def representative(pairs: DataFrame, threshold: float = S.PRIMARY_ISO) -> DataFrame:
    """A unit's iso-accuracy pair of lowest partition agreement, then by seeds."""
    key = F.struct("partition_ari", "seed_r", "seed_s")
    return iso_pairs(pairs, threshold).groupBy(*UNIT).agg(F.min_by(F.struct("seed_r", "seed_s", "ari_r", "ari_s", "abs_difference", "partition_ari"), key).alias("p")).select(*UNIT, "p.*")


def stable_control(pairs: DataFrame, threshold: float = S.PRIMARY_ISO, caliper: float = S.CALIPER) -> DataFrame:
    """For each unit's representative, the other pair of highest agreement whose score difference is within the caliper of its own.

    Where none is, the pair of nearest difference. Ties go by agreement (high first), then seeds.
    """
    r = representative(pairs, threshold).select(*UNIT, *(F.col(c).alias(f"u_{c}") for c in ("seed_r", "seed_s", "abs_difference", "partition_ari")))
    gap = F.abs(F.col("abs_difference") - F.col("u_abs_difference"))
    rows = pairs.join(r, list(UNIT)).where((F.col("seed_r") != F.col("u_seed_r")) | (F.col("seed_s") != F.col("u_seed_s"))).withColumn("gap", gap).withColumn("within", gap <= caliper + S.EPS)
    order = Window.partitionBy(*UNIT).orderBy(F.desc("within"), F.when(F.col("within"), 0.0).otherwise(F.col("gap")), F.desc("partition_ari"), "seed_r", "seed_s")
    best = rows.withColumn("k", F.row_number().over(order)).where("k = 1")
    return best.select(*UNIT, F.col("u_seed_r").alias("unstable_r"), F.col("u_seed_s").alias("unstable_s"), F.col("u_partition_ari").alias("unstable_ari"), F.col("seed_r").alias("stable_r"), F.col("seed_s").alias("stable_s"), F.col("partition_ari").alias("stable_ari"), "gap", F.col("within").alias("within_caliper"))


def global_example(pairs: DataFrame, threshold: float = S.PRIMARY_ISO) -> DataFrame:
    """The iso-accuracy pair of lowest agreement over all units."""
    return iso_pairs(pairs, threshold).orderBy("partition_ari", *UNIT, "seed_r", "seed_s").limit(1)


def decoupling(units: DataFrame, x: str = "reference_ari_sd", y: str = "instability") -> DataFrame:
    """Spearman over units."""
    return spearman(units, [], x, y).withColumnRenamed("n", "n_units")


def seed_percentile(accuracy: DataFrame, seed: int = 1) -> DataFrame:
    """100 times the share of a unit's scores that are at most the given seed's."""
    v = accuracy.where(F.col("seed") == seed).select(*UNIT, F.col("ari").alias("value"))
    return accuracy.join(v, list(UNIT)).groupBy(*UNIT).agg(F.max("value").alias("value"), (100 * F.avg((F.col("ari") <= F.col("value")).cast("double"))).alias("percentile"))


def headline(units: DataFrame, iso: DataFrame, threshold: float = S.PRIMARY_ISO) -> DataFrame:
    """One row of totals."""
    u = units.agg(F.count("*").alias("n_units"), F.countDistinct("dataset").alias("n_datasets"), F.countDistinct("method").alias("n_methods"), F.sum("n_seeds").alias("n_runs"), F.count_if("low_sd_high_instability").alias("n_low_sd_high_instability"), F.median("instability").alias("median_instability"), quantile("instability", 0.25).alias("q25_instability"), quantile("instability", 0.75).alias("q75_instability"))
    i = iso.where(S.close(F.col("threshold"), threshold)).agg(F.sum("n_iso_pairs").alias("n_iso_pairs"), F.sum("n_divergent").alias("n_divergent"), F.count_if("contains_divergent").alias("n_units_with_divergent"), S.masked_divide(F.sum("n_divergent").cast("double"), F.sum("n_iso_pairs").cast("double")).alias("divergent_fraction"))
    return u.crossJoin(i)  # one row by one row


def classification(units: DataFrame, iso: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """STRONG if every component holds, WEAK if at most one does, else PARTIAL."""
    h = headline(units, iso).crossJoin(decoupling(units).select("spearman"))  # one row each
    parts = {
        "has_divergent": F.col("n_divergent") > 0,
        "widespread": 2 * F.col("n_units_with_divergent") >= F.col("n_units"),
        "unstable": F.col("median_instability") >= S.HIGH_INSTABILITY,
        "decoupled": F.coalesce(F.abs("spearman") < 0.5, F.lit(False)),
    }
    h = h.select(*(c.alias(n) for n, c in parts.items()))
    total = sum((F.col(n).cast("int") for n in parts), F.lit(0))
    return h.withColumn("n_components", total).withColumn("class", F.when(total == len(parts), "STRONG").when(total <= 1, "WEAK").otherwise("PARTIAL"))


#: What a component of the assessment can say, and what all of them together.
LABELS = ("NOT_ESTIMABLE", "SUPPORTS_EXISTING_PATTERN", "DOES_NOT_SUPPORT", "HETEROGENEOUS")
OVERALL = ("CONTRASTING_STOCHASTIC_PROFILE", "STRONG_METHOD_GENERALIZATION", "PARTIAL_METHOD_GENERALIZATION", "LIMITED_METHOD_GENERALIZATION")
#: The two components of which both have to fail for a contrasting profile.
CORE_COMPONENTS = ("score_map_decoupling", "iso_accuracy_map_divergence")


def component_counts(flags: dict[str, DataFrame], column: str = "flag") -> DataFrame:
    """component, yes, n: how many of each table's flags are true, and how many aren't null."""
    parts = [df.agg(F.count_if(F.col(column)).alias("yes"), F.count(F.col(column)).alias("n")).select(F.lit(name).alias("component"), "yes", "n") for name, df in flags.items()]
    return reduce(DataFrame.unionByName, parts)


def component_labels(counts: DataFrame, core: tuple[str, ...] = CORE_COMPONENTS) -> DataFrame:
    """component, yes, n, label, overall of component counts: a component supports if all entries do, and doesn't if none does.

    Overall: contrasting if no core component has support; else strong with four supporting and none that doesn't, partial with two, limited otherwise.
    """
    label = F.when(F.col("n") == 0, LABELS[0]).when(F.col("yes") == F.col("n"), LABELS[1]).when(F.col("yes") == 0, LABELS[2]).otherwise(LABELS[3])
    rows = counts.withColumn("label", label)
    supports, fails = F.count_if(F.col("label") == LABELS[1]), F.count_if(F.col("label") == LABELS[2])
    contrast = F.count_if(F.col("component").isin(*core) & (F.col("label") == LABELS[2])) == len(core)
    overall = rows.agg(F.when(contrast, OVERALL[0]).when((supports >= 4) & (fails == 0), OVERALL[1]).when(supports >= 2, OVERALL[2]).otherwise(OVERALL[3]).alias("overall"))
    return rows.crossJoin(overall)  # a row per component by one row
