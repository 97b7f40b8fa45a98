"""Agreement of partitions: contingency tables, adjusted Rand index, normalised mutual information.

All metrics come from contingency counts. Pair metrics never self-join the runs: each observation's labels are gathered in one array
(one shuffle), and each task adds up the products of the labels' indicators (a Gram matrix per unit), whose cells are the
contingency counts of all pairs of seeds; only those, about k*k per pair and task, are shuffled again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.plans.shipping import ship
from seedquorum.plans.workspace import Workspace

UNIT = ("dataset", "method")


def contingency(rows: DataFrame, keys: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """keys, a, b, n."""
    return rows.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def agreement(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_obs, k_a, k_b, ari, nmi from contingency cells; one shuffle on the keys serves both margins and the sums."""
    d = cells.repartition(*keys) if keys else cells.coalesce(1)
    d = d.withColumns({"na": F.sum("n").over(Window.partitionBy(*keys, "a")), "nb": F.sum("n").over(Window.partitionBy(*keys, "b")), "nn": F.sum("n").over(Window.partitionBy(*keys))})
    one = d.groupBy(*keys).agg(
        F.max("nn").alias("n_obs"),
        F.countDistinct("a").alias("k_a"),
        F.countDistinct("b").alias("k_b"),
        # a margin's pairs, shared out over its cells: sum of n * (margin - 1) / 2
        F.expr("cast(sum(n * (n - 1)) AS double) / 2D").alias("s"),
        F.expr("cast(sum(n * (na - 1)) AS double) / 2D").alias("pa"),
        F.expr("cast(sum(n * (nb - 1)) AS double) / 2D").alias("pb"),
        F.expr("sum(cast(n AS double) / nn * ln(cast(n AS double) * nn / (cast(na AS double) * nb)))").alias("mi"),
        F.expr("-sum(cast(n AS double) / nn * ln(cast(na AS double) / nn))").alias("ha"),
        F.expr("-sum(cast(n AS double) / nn * ln(cast(nb AS double) / nn))").alias("hb"),
    )
    one = one.withColumn("e", F.expr("coalesce(try_divide(pa * pb, cast(n_obs AS double) * (n_obs - 1) / 2D), 0D)"))
    same = "(s = pa AND s = pb)"  # identical up to names
    ari = f"CASE WHEN {same} OR (pa + pb) / 2D - e = 0D THEN 1D ELSE (s - e) / ((pa + pb) / 2D - e) END"
    nmi = f"CASE WHEN k_a = 1 AND k_b = 1 THEN 1D WHEN k_a = 1 OR k_b = 1 THEN 0D WHEN {same} THEN 1D ELSE greatest(mi, 0D) / ((ha + hb) / 2D) END"
    return one.select(*keys, "n_obs", "k_a", "k_b", F.expr(ari).alias("ari"), F.expr(nmi).alias("nmi"))


def seed_accuracy(runs: DataFrame, weight: str | None = None) -> DataFrame:
    """One row per run against the reference labels that aren't null: n_obs, k_ref, k_observed, ari, nmi. ``weight``: the observations that a row stands for."""
    keys = [*UNIT, "seed"]
    out = agreement(contingency(runs.where(F.col("ref").isNotNull()), keys, "ref", "cluster", weight), keys)
    return out.withColumnsRenamed({"k_a": "k_ref", "k_b": "k_observed"})


#: Numbers that a task's Gram matrices hold before their cells are given out.
GRAM_SIZE = 1 << 23
#: Distinct labels that are broadcast to give them numbers; of more, a join that Spark may split.
BROADCAST_LABELS = 100_000


def label_codes(runs: DataFrame, by: list[str], columns: list[str], work: Workspace) -> tuple[DataFrame, DataFrame]:
    """``runs`` with ``code`` in place of ``columns``, and the codes' table (by, columns, code): numbers from 0 within ``by``, in the columns' order.

    Null labels have a code. The table has a row per distinct label, not per observation.
    """
    order = Window.partitionBy(*by).orderBy(*columns)
    codes = work.write(runs.select(*by, *columns).distinct().withColumn("code", (F.row_number().over(order) - 1).cast("int")), "codes")
    c = (F.broadcast(codes) if codes.count() <= BROADCAST_LABELS else codes).alias("c")
    on = reduce(lambda x, y: x & y, (F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, *columns]))
    rest = [k for k in runs.columns if k not in columns]
    return runs.alias("r").join(c, on).select(*(F.col(f"r.{k}").alias(k) for k in rest), F.col("c.code").alias("code")), codes


class _Gram:
    """Counts of pairs of one unit's codes; grows with the codes seen."""

    def __init__(self):
        self.codes = np.zeros(0, np.int64)
        self.n = np.zeros((0, 0), np.int64)

    def add(self, codes: np.ndarray, row: np.ndarray, weight: np.ndarray | None = None) -> None:
        """codes, and row: the entry's observation, numbered from 0; weight: the observations that each of these stands for."""
        new = np.setdiff1d(codes, self.codes)
        if len(new):
            every = np.union1d(self.codes, new)
            place, grown = np.searchsorted(every, self.codes), np.zeros((len(every),) * 2, np.int64)
            grown[np.ix_(place, place)] = self.n
            self.codes, self.n = every, grown
        own, size = np.searchsorted(self.codes, codes), len(self.codes)
        step = max(1, GRAM_SIZE // size)
        for k in range(0, int(row[-1]) + 1, step):
            x = np.zeros((min(step, int(row[-1]) + 1 - k), size), np.float32)
            part = slice(*np.searchsorted(row, (k, k + step)))
            x.ravel()[(row[part] - k) * size + own[part]] = 1
            self.n += (x.T @ x if weight is None else (x * weight[k : k + len(x), None].astype(float)).T @ x.astype(float)).astype(np.int64)


def _cells(batches):
    """(dataset, method, i, j, n) of rows (dataset, method, codes): how many observations of a unit have both codes, summed in this task."""
    units: dict[tuple, _Gram] = {}

    def out():
        for (dataset, method), g in units.items():
            i, j = np.nonzero(np.triu(g.n, 1))
            cols = [pa.array([dataset] * len(i), pa.string()), pa.array([method] * len(i), pa.string()), pa.array(g.codes[i]), pa.array(g.codes[j]), pa.array(g.n[i, j])]
            yield pa.RecordBatch.from_arrays(cols, ["dataset", "method", "i", "j", "n"])
        units.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        dataset, method = (batch.column(c).dictionary_encode(null_encoding="encode") for c in UNIT)
        unit = dataset.indices.to_numpy().astype(np.int64) * len(method.dictionary) + method.indices.to_numpy()
        lists = batch.column("codes")
        row, codes = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        for u in np.unique(unit):
            mine = unit[row] == u
            if mine.any():
                name = (dataset.dictionary[int(u) // len(method.dictionary)].as_py(), method.dictionary[int(u) % len(method.dictionary)].as_py())
                units.setdefault(name, _Gram()).add(codes[mine], (np.cumsum(unit == u) - 1)[row[mine]])
        if sum(g.n.size for g in units.values()) > GRAM_SIZE:
            yield from out()
    yield from out()


def pair_agreement(runs: DataFrame) -> DataFrame:
    """One row per unordered pair of seeds, over all observations: seed_r < seed_s, ari, nmi. A null label is a label; nulls in the keys are groups."""
    work = Workspace(runs.sparkSession, "pairs")
    coded, codes = label_codes(runs.select(*UNIT, "obs_id", "seed", "cluster"), [], ["seed", "cluster"], work)
    rows = coded.groupBy(*UNIT, "obs_id").agg(F.collect_list("code").alias("codes")).select(*UNIT, "codes")
    n = rows.mapInArrow(_cells, "dataset string, method string, i long, j long, n long").groupBy(*UNIT, "i", "j").agg(F.sum("n").alias("n"))
    named = F.broadcast(codes) if codes.count() <= BROADCAST_LABELS else codes
    side = lambda at, s, c: named.select(F.col("code").cast("long").alias(at), F.col("seed").alias(s), F.col("cluster").alias(c))
    cells = n.join(side("i", "seed_r", "a"), "i").join(side("j", "seed_s", "b"), "j").where("seed_r < seed_s")
    keys = [*UNIT, "seed_r", "seed_s"]
    return agreement(cells.select(*keys, "a", "b", "n"), keys).select(*keys, "n_obs", "ari", "nmi")


def _vector_cells(batches):
    """(dataset, method, seed_r, a, seed_s, b, n) of rows (dataset, method, sig, weight), summed in this task."""
    units: dict[tuple, _Gram] = {}
    numbers: dict[tuple, int] = {}
    columns = ("dataset", "method", "seed_r", "a", "seed_s", "b", "n")

    def out():
        names = list(numbers)
        for (dataset, method), g in units.items():
            i, j = np.nonzero(g.n)
            found = [(dataset, method, *names[g.codes[x]], *names[g.codes[y]], int(g.n[x, y])) for x, y in zip(i, j, strict=True) if names[g.codes[x]][0] < names[g.codes[y]][0]]
            if found:
                cols = list(zip(*found, strict=True))
                types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], columns)
        units.clear()
        numbers.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        dataset, method = (batch.column(c).dictionary_encode(null_encoding="encode") for c in UNIT)
        unit = dataset.indices.to_numpy().astype(np.int64) * len(method.dictionary) + method.indices.to_numpy()
        lists, weight = batch.column("sig"), batch.column("weight").to_numpy()
        flat = lists.flatten()
        cluster = flat.field("cluster").dictionary_encode(null_encoding="encode")
        both, of = np.unique(flat.field("seed").to_numpy().astype(np.int64) * len(cluster.dictionary) + cluster.indices.to_numpy(), return_inverse=True)
        code = np.array([numbers.setdefault((int(x) // len(cluster.dictionary), cluster.dictionary[int(x) % len(cluster.dictionary)].as_py()), len(numbers)) for x in both], np.int64)[of]
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        for u in np.unique(unit):
            mine = unit[row] == u
            if mine.any():
                name = (dataset.dictionary[int(u) // len(method.dictionary)].as_py(), method.dictionary[int(u) % len(method.dictionary)].as_py())
                units.setdefault(name, _Gram()).add(code[mine], (np.cumsum(unit == u) - 1)[row[mine]], weight[unit == u])
        if sum(g.n.size for g in units.values()) > GRAM_SIZE:
            yield from out()
    yield from out()


def vector_agreement(vectors: DataFrame) -> DataFrame:
    """``pair_agreement`` of label vectors (dataset, method, sig, weight; see consensus.label_vectors): observations with the same labels count together."""
    ship(vectors.sparkSession)
    keys = [*UNIT, "seed_r", "seed_s"]
    cells = vectors.select(*UNIT, "sig", "weight").mapInArrow(_vector_cells, "dataset string, method string, seed_r int, a string, seed_s int, b string, n long")
    return agreement(cells.groupBy(*keys, "a", "b").agg(F.sum("n").alias("n")), keys).select(*keys, "n_obs", "ari", "nmi")


def seed_pairs(accuracy: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pair table: both seeds' reference scores, their difference, and the iso-accuracy flags."""
    from seedquorum.functions.scalar import ISO_THRESHOLDS, iso_accuracy

    one = lambda s: accuracy.select(*UNIT, F.col("seed").alias(f"seed_{s}"), F.col("ari").alias(f"ari_{s}"), F.col("nmi").alias(f"nmi_{s}"))
    out = pairs.withColumnsRenamed({"ari": "partition_ari", "nmi": "partition_nmi"}).join(one("r"), [*UNIT, "seed_r"]).join(one("s"), [*UNIT, "seed_s"])
    out = out.withColumn("abs_difference", F.abs(F.col("ari_r") - F.col("ari_s")))
    return out.withColumns({f"iso_{int(round(t * 100)):03d}": iso_accuracy(F.col("ari_r"), F.col("ari_s"), t) for t in ISO_THRESHOLDS})


def observed_k(runs: DataFrame) -> DataFrame:
    """Fewest and most clusters that a unit's seeds produced."""
    k = runs.groupBy(*UNIT, "seed").agg(F.countDistinct("cluster").alias("k"))
    return k.groupBy(*UNIT).agg(F.min("k").alias("k_min"), F.max("k").alias("k_max"))


def repeatability(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two runs of one seed: agreement, and whether they are the same partition up to names."""
    # a side has a row per observation, though what it stems from can be small: never broadcast
    both = left.select(*keys, "obs_id", F.col("cluster").alias("a")).hint("merge").join(right.select(*keys, "obs_id", F.col("cluster").alias("b")).hint("merge"), [*keys, "obs_id"])
    return paired(both, keys)


def paired(both: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """``repeatability`` of two runs whose labels ``a`` and ``b`` are in the same row. ``weight``: the observations that a row stands for."""
    return agreement(contingency(both, keys, "a", "b", weight), keys).withColumn("identical", F.col("ari") == 1)


def embedding_difference(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Largest and mean absolute difference of two embeddings of the same observations, and whether all are close."""
    both = left.select("obs_id", F.col("embedding").alias("u")).join(right.select("obs_id", F.col("embedding").alias("v")), "obs_id")
    d = both.select(F.explode(F.zip_with("u", "v", lambda x, y: F.abs(x - y))).alias("d"))
    return d.agg(F.max("d").alias("max_abs"), F.avg("d").alias("mean_abs"), F.bool_and(F.col("d") <= tolerance).alias("all_close"))
