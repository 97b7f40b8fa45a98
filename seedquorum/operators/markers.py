"""Marker genes of clusters: one-vs-rest rank sums, top-k overlap, rank correlation, frequency.

Zeros are never materialised: a gene's zeros are one block of ties below its non-zero values, so a cluster's rank sum is that of its non-zero
entries plus (members - its non-zero entries) times the block's midrank. Values must not be negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.functions import scalar as S
from seedquorum.operators import stats
from seedquorum.operators.agreement import label_codes
from seedquorum.operators.selection import value_ranks
from seedquorum.plans.shipping import ship
from seedquorum.plans.workspace import Workspace

RUN = ("dataset", "method", "seed")


#: Sums that a task holds before they are given out.
SUMS = 1 << 22


def _label_sums(labels: int):
    """(dataset, gene, r, codes) to (dataset, gene, code, r, k): rank sums and entries by label, summed in this task. Codes are below ``labels``."""

    def run(batches):
        genes: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for (dataset, gene), (r, k) in genes.items():
                c = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array([dataset] * len(c), pa.string()), pa.array([gene] * len(c), pa.int64()), pa.array(c.astype(np.int32)), pa.array(r[c]), pa.array(k[c])], ["dataset", "gene", "code", "r", "k"])
            genes.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            dataset, gene = (batch.column(c).dictionary_encode(null_encoding="encode") for c in ("dataset", "gene"))
            both = dataset.indices.to_numpy().astype(np.int64) * len(gene.dictionary) + gene.indices.to_numpy()
            names, of_row = np.unique(both, return_inverse=True)
            lists = batch.column("codes")
            n = np.diff(lists.offsets.to_numpy())
            key = np.repeat(of_row, n) * labels + lists.flatten().to_numpy()
            r = np.bincount(key, np.repeat(batch.column("r").to_numpy(), n), len(names) * labels).reshape(-1, labels)
            k = np.bincount(key, minlength=len(names) * labels).reshape(-1, labels)
            for i, x in enumerate(names):
                name = (dataset.dictionary[int(x) // len(gene.dictionary)].as_py(), gene.dictionary[int(x) % len(gene.dictionary)].as_py())
                if name in genes:
                    genes[name][0][:] += r[i]
                    genes[name][1][:] += k[i]
                else:
                    genes[name] = r[i].copy(), k[i].copy()
            if len(genes) * labels > SUMS:
                yield from out()
        yield from out()

    return run


def label_arrays(labels: DataFrame, sizes: DataFrame, k: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(dataset, obs_id, codes) and the codes' table (dataset, method, seed, cluster, n1, code) of (dataset, method, obs_id, labels).

    A code is the number of the method, the seed and the label, in that order; labels are from 0 below ``k``, seeds from 1. Methods are few.
    """
    methods = sorted(x[0] for x in sizes.select("method").distinct().collect())
    seeds = sizes.agg(F.max("seed")).first()[0] or 1
    first = (F.array_position(F.array(*map(F.lit, methods)), F.col("method")).cast("int") - 1) * (seeds * k) if methods else F.lit(0)
    codes = work.write(sizes.withColumn("code", (first + (F.col("seed") - 1) * k + F.col("cluster")).cast("int")), "codes")
    rows = labels.withColumn("first", first).select("dataset", "obs_id", F.transform("labels", lambda x, i: F.col("first") + i * k + x).alias("codes"))
    return rows.groupBy("dataset", "obs_id").agg(F.flatten(F.collect_list("codes")).alias("codes")), codes


def rank_sum_markers(expression: DataFrame, runs: DataFrame) -> DataFrame:
    """(dataset, method, seed, domain, gene, z, rank): every gene of the dataset for every domain of a run.

    z has no tie correction; ranks go by z descending, then gene. A domain that holds all observations has z NULL. Genes are whole numbers.

    An observation's labels are one array of small numbers, which meets its entries once; tasks add up the rank sums of each gene and label.
    """
    work = Workspace(runs.sparkSession, "markers")
    n = runs.select("dataset", "obs_id").distinct().groupBy("dataset").agg(F.count("*").alias("nn"))
    coded, codes = label_codes(runs.select("dataset", "obs_id", "method", "seed", "cluster"), ["dataset"], ["method", "seed", "cluster"], work)
    size = coded.groupBy("dataset", "code").agg(F.count("*").alias("n1"))
    return _rank_sums(expression, coded.groupBy("dataset", "obs_id").agg(F.collect_list("code").alias("codes")), codes, size, n, work)


def label_markers(expression: DataFrame, labels: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """``rank_sum_markers`` of (dataset, method, obs_id, labels), a label from 0 below ``k`` for each seed; ``sizes``: dataset, method, seed, cluster, n1."""
    work = Workspace(labels.sparkSession, "markers")
    n = sizes.groupBy(*RUN).agg(F.sum("n1").alias("nn")).groupBy("dataset").agg(F.max("nn").alias("nn"))
    arrays, codes = label_arrays(labels, sizes, k, work)
    return _rank_sums(expression, arrays, codes, codes.select("dataset", "code", "n1"), n, work)


def _rank_sums(expression: DataFrame, labels: DataFrame, codes: DataFrame, size: DataFrame, n: DataFrame, work: Workspace) -> DataFrame:
    """``labels``: dataset, obs_id, codes; ``size``: dataset, code, n1; ``n``: dataset, nn."""
    ship(labels.sparkSession)
    most = codes.agg(F.max("code")).first()[0]
    nz = expression.where("value > 0").select("dataset", "obs_id", "gene", "value")
    ranks = value_ranks(nz, ["dataset", "gene"], "value", work)
    ranks = work.write(ranks, "ranks")
    genes = ranks.groupBy("dataset", "gene").agg(F.sum("n").alias("nonzero")).join(n, "dataset").select("dataset", "gene", "nn", (F.col("nn") - F.col("nonzero")).alias("zeros"))
    # a non-zero's rank is that among the gene's non-zeros, above its zeros
    ranked = nz.join(ranks, ["dataset", "gene", "value"]).join(labels, ["dataset", "obs_id"]).select("dataset", F.col("gene").cast("long").alias("gene"), F.col("rank").alias("r"), "codes")
    own = ranked.mapInArrow(_label_sums((most or 0) + 1), "dataset string, gene long, code int, r double, k long")
    own = own.groupBy("dataset", "gene", "code").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))
    grid = size.join(genes, "dataset").join(own, ["dataset", "gene", "code"], "left")
    total = "coalesce(r + k * zeros, 0D) + (n1 - coalesce(k, 0)) * (zeros + 1) / 2D"
    z = f"try_divide({total} - n1 * (nn + 1) / 2D, sqrt(cast(n1 AS double) * (nn - n1) * (nn + 1) / 12D))"
    named = codes.select("dataset", "code", "method", "seed", F.col("cluster").alias("domain"))
    out = grid.join(named, ["dataset", "code"]).select(*RUN, "domain", "gene", F.expr(f"round({z}, 9)").alias("z"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*RUN, "domain").orderBy(F.desc_nulls_last("z"), "gene")))


def top(markers: DataFrame, k: int) -> DataFrame:
    return markers.where(F.col("rank") <= k)


def pair_metrics(markers: DataFrame, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """Per pair of seeds and domain both have: top-k Jaccard s / (2k - s) and full-rank Spearman.

    Ranks of a gene are gathered over seeds (at most one per seed and domain), and the pairs are read off that array: no self join.
    ``pairs`` (dataset, method, seed_r, seed_s) limits the result.
    """
    n = markers.groupBy(*RUN, "domain").agg(F.count("*").alias("n"))
    m = markers.join(n, [*RUN, "domain"]).groupBy("dataset", "method", "domain", "gene", "n").agg(F.sort_array(F.collect_list(F.struct("seed", "rank"))).alias("s"))
    both = F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x.seed AS seed_r, y.seed AS seed_s, x.rank AS a, y.rank AS b))))")
    rows = m.select("dataset", "method", "domain", "n", F.explode(both).alias("p")).select("dataset", "method", "domain", "n", "p.*")
    keys = ["dataset", "method", "seed_r", "seed_s"]
    if pairs is not None:
        rows = rows.join(pairs.select(*keys), keys, "left_semi")
    out = rows.groupBy(*keys, "domain").agg(F.count_if(F.expr(f"a <= least({k}, n) AND b <= least({k}, n)")).alias("s"), F.max(F.least(F.lit(k), "n")).alias("k"), F.sum(F.expr("cast((a - b) * (a - b) AS double)")).alias("d2"), F.max("n").alias("n"))
    return out.select(*keys, "domain", F.expr("try_divide(cast(s AS double), 2 * k - s)").alias("jaccard"), F.expr("1 - try_divide(6 * d2, cast(n AS double) * (cast(n AS double) * n - 1))").alias("rank_spearman"))


def pair_rows(pairs: DataFrame, metrics: dict[str, DataFrame]) -> DataFrame:
    """Every pair with the medians over its common domains; NULL where there are none. ``metrics``: column prefix -> pair_metrics."""
    keys = ["dataset", "method", "seed_r", "seed_s"]
    out = pairs
    for name, m in metrics.items():
        out = out.join(m.groupBy(*keys).agg(F.median("jaccard").alias(f"{name}_jaccard"), F.median("rank_spearman").alias(f"{name}_rank_spearman"), F.count("*").alias(f"{name}_domains")), keys, "left")
    return out


def marker_frequency(markers: DataFrame, k: int, seeds: int = 20) -> DataFrame:
    """How many of all seeds have a gene in a domain's top k, with its class."""
    f = top(markers, k).groupBy("dataset", "method", "domain", "gene").agg(F.count("*").alias("n_seeds")).withColumn("frequency", F.col("n_seeds") / F.lit(float(seeds)))
    return f.withColumn("class", S.classify(F.col("frequency"), S.FREQUENT, S.RARE, (">=80%", "20-80%", "<=20%")))


def tertile_summary(rows: DataFrame, value: str = "jaccard") -> DataFrame:
    """Per unit and third of partition agreement, all three always present."""
    keys = ["dataset", "method"]
    t = stats.tertiles(rows, keys, "partition_ari", ["seed_r", "seed_s"]).groupBy(*keys, "tertile").agg(F.count("*").alias("n_pairs"), F.median("partition_ari").alias("median_partition_ari"), F.median(value).alias("median_value"))
    grid = rows.select(*keys).distinct().select("*", F.explode(F.array(*map(F.lit, ("Low", "Middle", "High")))).alias("tertile"))
    return grid.join(t, [*keys, "tertile"], "left").select(*keys, "tertile", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), "median_partition_ari", "median_value")


def overlap_counts(markers: DataFrame, k: int, seed_r: int, seed_s: int) -> DataFrame:
    """Per unit and domain of two seeds: genes only in the first's top k, shared, only in the second's."""
    keys = ["dataset", "method", "domain"]
    t = top(markers, k).where(F.col("seed").isin(seed_r, seed_s)).groupBy(*keys, "gene").agg(F.bool_or(F.col("seed") == seed_r).alias("r"), F.bool_or(F.col("seed") == seed_s).alias("s"))
    return t.groupBy(*keys).agg(F.count_if(F.expr("r AND NOT s")).alias("only_r"), F.count_if(F.expr("r AND s")).alias("shared"), F.count_if(F.expr("s AND NOT r")).alias("only_s"))
