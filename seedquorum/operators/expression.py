"""Expression triples (dataset, obs_id, gene, value); absent triples are zeros."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.plans.shipping import ship
from seedquorum.plans.workspace import Workspace


def gene_filter(expression: DataFrame, min_cells: int = 3, min_counts: float = 0) -> DataFrame:
    """Triples of genes seen in enough observations and often enough."""
    kept = expression.groupBy("dataset", "gene").agg(F.count_if(F.col("value") > 0).alias("cells"), F.sum("value").alias("counts"))
    kept = kept.where((F.col("cells") >= min_cells) & (F.col("counts") >= min_counts)).select("dataset", "gene")
    return expression.join(kept, ["dataset", "gene"], "left_semi")


def normalize_total(expression: DataFrame, target: float = 1e4) -> DataFrame:
    total = F.sum("value").over(Window.partitionBy("dataset", "obs_id"))
    return expression.withColumn("value", F.col("value") * target / total)


def normalize_log1p(expression: DataFrame, target: float = 1e4) -> DataFrame:
    return normalize_total(expression, target).withColumn("value", F.log1p("value"))


def gene_moments(expression: DataFrame, observations: DataFrame) -> DataFrame:
    """Mean and sample variance of a gene over all observations, zeros included."""
    n = observations.groupBy("dataset").agg(F.count("*").alias("n"))
    g = expression.groupBy("dataset", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(n, "dataset")
    return g.select("dataset", "gene", "n", (F.col("s") / F.col("n")).alias("mean"), F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1).alias("variance"))


def highly_variable(expression: DataFrame, observations: DataFrame, top: int = 3000, bins: int = 20) -> DataFrame:
    """Genes by dispersion (variance over mean, both logged) standardised within bins of mean; all if at most ``top``; ties by gene."""
    m = gene_moments(expression, observations).where("mean > 0").withColumns({"m": F.log1p("mean"), "d": F.log(F.greatest(F.try_divide(F.col("variance"), F.col("mean")), F.lit(1e-12)))})
    w = Window.partitionBy("dataset")
    width = (F.max("m").over(w) - F.min("m").over(w)) / bins
    m = m.withColumn("bin", F.least(F.coalesce(F.floor(F.try_divide(F.col("m") - F.min("m").over(w), width)), F.lit(0)), F.lit(bins - 1)))
    b = Window.partitionBy("dataset", "bin")
    score = F.when(F.count("*").over(b) > 1, F.try_divide(F.col("d") - F.avg("d").over(b), F.stddev_samp("d").over(b))).otherwise(F.lit(1.0))
    m = m.withColumn("score", F.coalesce(score, F.lit(0.0)))
    return m.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "gene"))).where(F.col("k") <= top).select("dataset", "gene", "mean", "variance", "score", "k")


def scale(expression: DataFrame, observations: DataFrame, clip: float = 10.0) -> DataFrame:
    """Divided by the gene's standard deviation, not centred (so zeros stay zeros), clipped; a constant gene is left alone."""
    sd = gene_moments(expression, observations).select("dataset", "gene", F.sqrt("variance").alias("sd"))
    out = expression.join(sd, ["dataset", "gene"])
    return out.select("dataset", "obs_id", "gene", F.least(F.col("value") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)), F.lit(clip)).alias("value"))


def matrix_statistics(expression: DataFrame) -> DataFrame:
    """Structural audit of the stored values: sizes, range, values that can't be, entries that are there more than once, and the share of the matrix that is stored."""
    v = F.col("value")
    one = expression.groupBy("dataset").agg(
        F.count("*").alias("n_stored"), F.countDistinct("gene").alias("n_genes"), F.countDistinct("obs_id").alias("n_obs"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_nonfinite"), F.count_if(v < 0).alias("n_negative"), F.bool_and(v == F.floor(v)).alias("all_integers"),
    )
    places = expression.groupBy("dataset", "obs_id", "gene").agg(F.count("*").alias("c")).groupBy("dataset").agg(F.sum(F.col("c") - 1).alias("n_duplicates"), F.count("*").alias("places"))
    out = one.join(places, "dataset").withColumn("density", F.col("places") / (F.col("n_genes") * F.col("n_obs")))
    return out.drop("places")


def marker_universe(genes: DataFrame, least: int = 100, exact: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The flagged genes (dataset, gene) of ``genes`` (dataset, gene, flagged), and (dataset, problem, n) of datasets whose universe can't be used.

    Problems: a flag that isn't known, no flagged gene, a gene flagged twice, fewer than ``least``, or another number than ``exact`` has for datasets of a prefix.
    """
    rows = genes.select("dataset", "gene", F.col("flagged").cast("boolean").alias("flagged"))
    kept = rows.where("flagged").select("dataset", "gene")
    once = rows.groupBy("dataset", "gene").agg(F.count_if(F.col("flagged")).alias("c"), F.count_if(F.col("flagged").isNull()).alias("unknown"))
    one = once.groupBy("dataset").agg(F.sum("unknown").alias("unknown"), F.count_if(F.col("c") > 0).alias("n"), F.count_if(F.col("c") > 1).alias("twice"))
    rules = [("unknown flags", F.col("unknown") > 0, "unknown"), ("empty", F.col("n") == 0, "n"), ("repeated genes", F.col("twice") > 0, "twice"), ("too few", (F.col("n") > 0) & (F.col("n") < least), "n")]
    rules += [(f"not {n}", F.col("dataset").startswith(prefix) & (F.col("n") != n), "n") for prefix, n in (exact or {}).items()]
    found = F.filter(F.array(*(F.when(bad, F.struct(F.lit(name).alias("problem"), F.col(c).alias("n"))) for name, bad, c in rules)), lambda x: x.isNotNull())
    return kept, one.select("dataset", F.explode(found).alias("x")).select("dataset", "x.*")


#: Genes whose local regressions one task makes at a time; it holds two numbers of each gene of the dataset.
GENES_A_TASK = 512


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    """Local regression of second degree: at each place of ``at`` the weighted least squares over the nearest ``span`` of points, with tricube weights.

    Where these points can't settle a parabola, the shortest solution counts.
    """
    k = min(len(x), max(1, int(np.ceil(span * len(x)))))
    out = np.empty(len(at))
    for i, place in enumerate(at):
        far = np.abs(x - place)
        h = np.partition(far, k - 1)[k - 1]
        if h <= 0:
            out[i] = y[far <= 0].mean()
            continue
        near = far < h
        u = (x[near] - place) / h
        w = np.sqrt((1 - np.abs(u) ** 3) ** 3)
        out[i] = np.linalg.lstsq(np.vander(u, 3, increasing=True) * w[:, None], y[near] * w, rcond=1e-10)[0][0]
    return out


def standardized_variance(expression: DataFrame, observations: DataFrame, span: float = 0.3) -> DataFrame:
    """dataset, gene, mean, variance, expected, score of counts: the variance of counts over their expected standard deviation, clipped at the square root of the observations.

    The expected variance is a local regression of its logarithm on that of the mean, over a dataset's genes of positive variance; the others score 0.
    Blocks of genes are fitted in separate tasks, each with the dataset's means and variances.
    """
    ship(expression.sparkSession)
    work = Workspace(expression.sparkSession, "variance")
    m = work.write(gene_moments(expression, observations), "moments")
    fit = m.where("variance > 0 AND mean > 0").select("dataset", "gene", F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    whole = fit.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("x", "y", "gene"))).alias("all"))
    block = whole.select("dataset", "all", F.explode(F.expr(f"sequence(0, (size(all) - 1) div {GENES_A_TASK})")).alias("block")).repartition("dataset", "block")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                x, y, genes = (np.array([g[k] for g in r.all]) for k in ("x", "y", "gene"))
                mine = slice(r.block * GENES_A_TASK, (r.block + 1) * GENES_A_TASK)
                yield pd.DataFrame({"dataset": r.dataset, "gene": genes[mine], "expected": 10 ** local_quadratic(x, y, x[mine], span)})

    gene_type = dict(expression.dtypes)["gene"]
    expected = work.write(block.mapInPandas(run, f"dataset string, gene {gene_type}, expected double"), "expected")
    top = m.join(expected, ["dataset", "gene"]).select("dataset", "gene", "n", "mean", "expected", (F.sqrt("expected") * F.sqrt("n") + F.col("mean")).alias("top"))
    clipped = expression.join(top, ["dataset", "gene"]).groupBy("dataset", "gene").agg(F.sum(F.least("value", "top")).alias("s"), F.sum(F.pow(F.least("value", "top"), 2)).alias("q"), F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("expected").alias("expected"))
    score = F.expr("(n * mean * mean + q - 2 * mean * s) / ((n - 1) * expected)")
    scored = clipped.select("dataset", "gene", "expected", score.alias("score"))
    return m.join(scored, ["dataset", "gene"], "left").select("dataset", "gene", "mean", "variance", "expected", F.coalesce("score", F.lit(0.0)).alias("score"))


def highly_variable_counts(expression: DataFrame, observations: DataFrame, top: int = 2000, span: float = 0.3) -> DataFrame:
    """The ``top`` genes of a dataset by standardized variance of their counts, with their place k; ties (to nine digits) by gene."""
    v = standardized_variance(expression, observations, span)
    k = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("score", 9)), "gene"))
    return v.withColumn("k", k).where(F.col("k") <= top)


def neighbour_weights(points: DataFrame, k: int = 15) -> DataFrame:
    """dataset, src, dst, weight: the k nearest others, weights falling as a Gaussian of the distance over the median of an observation's k distances, adding up to 1.

    Where that median is 0, neighbours at distance 0 share the weight.
    """
    from seedquorum.operators.spatial import nearest

    near = nearest(points, k).select("dataset", "src", F.struct("dst", "distance").alias("d"))
    near = near.groupBy("dataset", "src").agg(F.collect_list("d").alias("d"), F.median("d.distance").alias("m"))  # k values
    raw = near.select("dataset", "src", F.expr("transform(d, x -> struct(x.dst AS dst, CASE WHEN m > 0 THEN exp(-(x.distance / m) * (x.distance / m)) WHEN x.distance = 0 THEN 1D ELSE 0D END AS w))").alias("d"))
    return raw.select("dataset", "src", F.expr("inline(transform(d, x -> struct(x.dst AS dst, x.w / aggregate(d, 0D, (a, y) -> a + y.w) AS weight)))"))


def neighbour_mean(expression: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted mean over an observation's neighbours (dataset, src, dst, weight), zeros included. Without a weight column all count alike."""
    if "weight" not in edges.columns:
        degree = edges.groupBy("dataset", "src").agg(F.count("*").alias("k"))
        edges = edges.join(degree, ["dataset", "src"]).select("dataset", "src", "dst", (1 / F.col("k")).alias("weight"))
    both = edges.join(expression.withColumnRenamed("obs_id", "dst"), ["dataset", "dst"])
    return both.groupBy("dataset", F.col("src").alias("obs_id"), "gene").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def neighbour_matrix(expression: DataFrame, points: DataFrame, k: int = 15, share: float = 0.2, least: float = 1e-12) -> DataFrame:
    """dataset, obs_id, part (own, neighbours), gene, value: own and neighbours' expression over their standard deviations, weighed by the roots of 1 - share and share.

    Genes whose variance over all observations is at most ``least`` in either part go from both. Values aren't centred, so absent ones stay zeros; principal components centre.
    """
    work = Workspace(expression.sparkSession, "neighbours")
    near = work.write(neighbour_mean(expression, neighbour_weights(points, k)), "means")
    moments = lambda e: gene_moments(e, points).select("dataset", "gene", F.expr("variance * (n - 1) / n").alias("variance")).where(F.col("variance") > least)
    own_v, near_v = moments(expression).withColumnRenamed("variance", "own"), moments(near).withColumnRenamed("variance", "near")
    kept = work.write(own_v.join(near_v, ["dataset", "gene"]), "kept")
    part = lambda e, v, name, weight: e.join(kept, ["dataset", "gene"]).select("dataset", "obs_id", F.lit(name).alias("part"), "gene", (F.col("value") * (weight**0.5) / F.sqrt(v)).alias("value"))
    return part(expression, "own", "own", 1 - share).unionByName(part(near, "near", "neighbours", share))


def _product(entries: DataFrame, dense: DataFrame, by: str, to: str, size: int) -> DataFrame:
    """Sparse (dataset, obs_id, gene, value) times a dense factor of columns v0.. keyed by ``by``: rows keyed by ``to``. Sums begin in the tasks."""
    both = entries.join(dense, ["dataset", by])
    return both.groupBy("dataset", to).agg(*(F.sum(F.col("value") * F.col(f"v{i}")).alias(f"v{i}") for i in range(size)))


def _gram(dense: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Per dataset the size x size products of a factor's columns; each task adds up its own rows first."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("dataset"):
                v = part.iloc[:, 1:].to_numpy()
                sums[name] = sums.get(name, 0) + v.T @ v
        yield pd.DataFrame([(n, i, x) for n, g in sums.items() for i, x in enumerate(g.ravel().tolist())], columns=["dataset", "i", "x"]).astype({"i": "int32", "x": "float64"})

    cells = dense.select("dataset", *(f"v{i}" for i in range(size))).mapInPandas(run, "dataset string, i int, x double").groupBy("dataset", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in cells.collect():  # size * size numbers a dataset
        out.setdefault(r["dataset"], np.zeros(size * size))[r["i"]] = r["x"]
    return {n: g.reshape(size, size) for n, g in out.items()}


def _turned(dense: DataFrame, key: str, size: int, by: dict[str, np.ndarray]) -> DataFrame:
    """A factor's rows times their dataset's size x size matrix."""

    def run(batches):
        for pdf in batches:
            for name, part in pdf.groupby("dataset"):
                yield part.assign(**{f"v{i}": c for i, c in enumerate((part.iloc[:, 2:].to_numpy() @ by[name]).T)})

    kinds = dict(dense.dtypes)
    cols = [f"v{i}" for i in range(size)]
    return dense.select("dataset", key, *cols).mapInPandas(run, ", ".join([f"dataset string, {key} {kinds[key]}", *(f"{c} double" for c in cols)]))


def principal_components(expression: DataFrame, observations: DataFrame, k: int = 20, extra: int = 10, rounds: int = 6, seed: int = 0) -> DataFrame:
    """dataset, obs_id, pc: scores on the k leading directions of the centred matrix, by a randomised range finder.

    Random weights of genes, hashed from their names and the seed, give k + ``extra`` mixtures, which ``rounds`` products with the matrix and its
    transpose turn towards the leading directions. Products are joins and sums of the stored entries; centring takes the mixtures'
    means away, so zeros are never stored. Only (k + extra)^2 numbers a dataset leave the tasks. A direction's sign makes its
    largest loading positive; directions that the matrix doesn't have are 0.
    """
    ship(expression.sparkSession)
    work = Workspace(expression.sparkSession, "components")
    size = k + extra
    cols = [f"v{i}" for i in range(size)]
    entries = work.write(expression.select("dataset", "obs_id", "gene", "value"), "entries")
    rows = work.write(observations.select("dataset", "obs_id").distinct(), "rows")
    n = {r["dataset"]: r["n"] for r in rows.groupBy("dataset").agg(F.count("*").alias("n")).collect()}  # a row a dataset

    def normal(i: int):
        u, v = (F.pmod(F.xxhash64("gene", F.lit(seed), F.lit(i), F.lit(part)), F.lit(1 << 40)) for part in (0, 1))
        return F.sqrt(-2 * F.log((u + 1) / float(1 << 40))) * F.cos(v * (2 * np.pi / (1 << 40)))

    def centred(product: DataFrame) -> DataFrame:
        full = work.write(rows.join(product, ["dataset", "obs_id"], "left").select("dataset", "obs_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in cols)), "full")
        mean = {r["dataset"]: np.array(r[1:]) for r in full.groupBy("dataset").agg(*(F.avg(c).alias(c) for c in cols)).collect()}  # a row a dataset

        def run(batches):
            for pdf in batches:
                for name, part in pdf.groupby("dataset"):
                    yield part.assign(**{f"v{i}": c for i, c in enumerate((part.iloc[:, 2:].to_numpy() - mean[name]).T)})

        return work.write(full.mapInPandas(run, full.schema), "centred")

    def orthonormal(dense: DataFrame) -> DataFrame:
        """Twice, as once loses half the digits."""
        for step in range(2):
            by = {}
            for name, g in _gram(dense, size).items():
                w, v = np.linalg.eigh(g)
                kept = w > max(w[-1], 0) * (1e-15 if step == 0 else 1e-6)
                by[name] = np.where(kept, v / np.sqrt(np.where(kept, w, 1)), 0)
            dense = work.write(_turned(dense, "obs_id", size, by), f"turned{step}")
        return dense

    genes = entries.select("dataset", "gene").distinct()
    weights = genes.select("dataset", "gene", *(normal(i).alias(c) for i, c in enumerate(cols)))
    for _ in range(rounds + 1):
        basis = orthonormal(centred(_product(entries, weights, "gene", "obs_id", size)))
        weights = work.write(_product(entries, basis, "obs_id", "gene", size), "weights")  # a basis of centred columns centres the product
    turn, strength = {}, {}
    for name, g in _gram(weights, size).items():
        w, v = np.linalg.eigh(g)
        order = np.argsort(-w)
        turn[name], strength[name] = v[:, order], np.sqrt(np.maximum(w[order], 0))
    loadings = _turned(weights, "gene", size, turn)
    signs = loadings.groupBy("dataset").agg(*(F.max_by(F.signum(c), F.struct(F.round(F.abs(F.col(c)), 9), "gene")).alias(c) for c in cols[:k])).collect()  # a row a dataset
    for r in signs:
        turn[r["dataset"]] = turn[r["dataset"]] * np.append([x or 1.0 for x in r[1:]], np.ones(extra)) * strength[r["dataset"]]
    out = _turned(basis, "obs_id", size, turn | {name: np.zeros((size, size)) for name in n if name not in turn})
    return out.select("dataset", "obs_id", F.array(*cols[:k]).alias("pc"))
