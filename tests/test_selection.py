"""Quantiles and midranks against NumPy, with ties, nulls, odd doubles and groups over several partitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedquorum.operators import selection


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for i in range(6000):
        out.append(("even", r.random(), float(r.randrange(5))))
    for i in range(3000):
        out.append((None, 1000 + r.random() * 1e-9, -math.exp(r.uniform(-700, 700))))
    for v in (0.0, -0.0, 5e-324, -5e-324, 1.7e308, float("nan"), float("inf"), None, -3.5):
        out.append(("odd", v, v))
    out += [("one", 2.5, None), ("none", None, float("nan"))]
    return spark.createDataFrame(out, "k string, x double, c double").repartition(5)


@pytest.mark.parametrize("few", [0, 1024])
def test_quantiles(rows, few, monkeypatch):
    """With few = 0 every bin is refined until it is one value."""
    monkeypatch.setattr(selection, "FEW", few)
    wanted = {"x0": ("x", 0.0), "x05": ("x", 0.05), "x50": ("x", 0.5), "x1": ("x", 1.0), "c25": ("c", 0.25), "c50": ("c", 0.5)}
    got = {r["k"]: r for r in selection.quantiles(rows, ["k"], wanted).collect()}
    data = rows.collect()
    assert set(got) == {r["k"] for r in data}
    for k, g in got.items():
        for name, (column, p) in wanted.items():
            own = [r[column] for r in data if r["k"] == k and r[column] is not None and math.isfinite(r[column])]
            assert g[f"n__{column}"] == len(own)
            assert g[name] is None if not own else math.isclose(g[name], float(np.quantile(own, p)), rel_tol=1e-12, abs_tol=1e-320), (k, name)


def test_quantiles_of_all_rows_and_of_none(rows):
    got = selection.quantiles(rows.where("k = 'even'"), [], {"m": ("x", 0.5)}).collect()
    assert len(got) == 1 and math.isclose(got[0]["m"], float(np.median([r["x"] for r in rows.where("k = 'even'").collect()])))
    assert selection.quantiles(rows.limit(0), ["k"], {"m": ("x", 0.5)}).count() == 0


def average_ranks(values):
    order = sorted(values)
    return {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(values)}


@pytest.mark.parametrize("keys", [["k"], []])
def test_midranks_over_partitions(spark, keys):
    """A fifth of the rows are one tie; its group lies over several range partitions."""
    r = random.Random(4)
    data = [(r.choice(["a", "b", None]), 7 if r.random() < 0.2 else r.randrange(300), i) for i in range(1500)] + [("a", None, -1), ("c", 1, -2)]
    rows = spark.createDataFrame(data, "k string, v int, i int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = selection.midranks(rows, keys, "v").collect()
        counts = rows.groupBy(*keys, "v").count().repartitionByRange(*keys, "v")
        assert counts.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(data)
    for group in {x[0] for x in data} if keys else {None}:
        own = [x["v"] for x in got if (x["k"] == group or not keys) and x["v"] is not None]
        want = average_ranks(own)
        assert all(x["rank"] == (want[x["v"]] if x["v"] is not None else None) for x in got if x["k"] == group or not keys)
