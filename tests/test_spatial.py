"""Neighbours, degrees and components where one cell holds a crowd, against all pairs."""

import numpy as np
import pytest

from seedquorum.operators import spatial


@pytest.fixture(scope="module")
def places():
    """A crowd of 600 within a hundredth of the radius, a heap on one place, a spread of 120, an edge exactly at the radius, outliers."""
    r = np.random.default_rng(2)
    crowd = 0.5 + r.normal(0, 0.001, (600, 2))
    heap = np.full((30, 2), 0.25)
    spread = r.uniform(-1, 2, (120, 2))
    edge = np.array([[3.0, 3.0], [3.0, 3.125], [3.125, 3.125], [-7.0, 1e6], [-7.0, 1e6], [-0.0, 0.0], [0.0, -0.0]])
    return np.concatenate([crowd, heap, spread, edge])


@pytest.fixture(scope="module")
def points(spark, places):
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(places)] + [("b", 2000 + i, float(x) * 100, float(y)) for i, (x, y) in enumerate(places[600:700])] + [("b", 3000, None, 1.0)]
    return spark.createDataFrame(rows, "dataset string, obs_id long, x double, y double").repartition(4)


def distances(xy):
    d = xy[:, None, :] - xy[None, :, :]
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])


@pytest.mark.parametrize("leaf", [4, 64])
def test_degrees_in_a_crowd(points, places, leaf):
    got = {r["obs_id"]: r["degree"] for r in spatial.degrees(points, 0.125, leaf).collect()}
    near = (distances(places) <= 0.125).sum(1) - 1
    assert [got[i] for i in range(len(places))] == near.tolist() and got[3000] == 0 and near.max() >= 599 and near[-7] == 1


def test_components_in_a_crowd(points, places):
    got = {r["obs_id"]: r["component"] for r in spatial.radius_components(points, 0.125, 8).collect()}
    near = distances(places) <= 0.125
    want = np.arange(len(places))
    while True:
        new = np.where(near, want[None, :], len(places)).min(1)
        if (new == want).all():
            break
        want = new
    assert [got[i] for i in range(len(places))] == want.tolist() and got[3000] == 3000 and len(set(want)) > 20


def test_nearest_in_a_crowd(points, places):
    got = {(r["src"], r["rank"]): (r["dst"], r["distance"]) for r in spatial.nearest(points, 5, 4).where("dataset = 'a'").collect()}
    d = distances(places)
    for i in range(len(places)):
        order = sorted((x, j) for j, x in enumerate(d[i]) if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, x) for x, j in order]


def test_no_points(points):
    none = points.limit(0)
    assert spatial.degrees(none, 1.0).count() == spatial.radius_components(none, 1.0).count() == spatial.nearest(none, 3).count() == 0
