"""Gene selection, neighbour matrices and principal components against dense NumPy."""

import numpy as np
import pytest

from seedquorum.operators import expression


@pytest.fixture(scope="module")
def counts():
    r = np.random.default_rng(0)
    out = {}
    for name, n, g in (("a", 90, 40), ("b", 30, 7)):
        rate = np.exp(r.uniform(-2, 3, g))
        x = r.poisson(rate * np.exp(r.normal(0, r.uniform(0, 1, g), (n, g)))).astype(float)
        x[:, 1] = 0
        x[:, 4] = x[:, 3]
        x[5] = 0
        x[:, 2] = 3
        out[name] = x
    return out


@pytest.fixture(scope="module")
def frames(spark, counts):
    rows = [(d, i, j, float(v)) for d, x in counts.items() for (i, j), v in np.ndenumerate(x) if v]
    obs = [(d, i, float(i % 9) ** 1.5, float(i // 9), 0) for d, x in counts.items() for i in range(len(x))]
    return spark.createDataFrame(rows, "dataset string, obs_id long, gene long, value double"), spark.createDataFrame(obs, "dataset string, obs_id long, x double, y double, label int")


def plain_scores(x, span):
    """Parabolas by polyfit, variance of clipped values by hand."""
    n, mean, var = len(x), x.mean(0), x.var(0, ddof=1)
    use = np.flatnonzero((var > 0) & (mean > 0))
    lx, ly = np.log10(mean[use]), np.log10(var[use])
    out = np.zeros(x.shape[1])
    for j, place in zip(use, lx, strict=True):
        far = np.abs(lx - place)
        h = np.sort(far)[int(np.ceil(span * len(lx))) - 1]
        near = far < h
        fit = np.polyfit((lx[near] - place) / h, ly[near], 2, w=np.sqrt((1 - (far[near] / h) ** 3) ** 3))[-1]
        sd = np.sqrt(10**fit)
        clipped = np.minimum(x[:, j], sd * np.sqrt(n) + mean[j])
        out[j] = ((clipped - mean[j]) ** 2).sum() / ((n - 1) * sd * sd)
    return out


def test_variable_genes_of_counts(frames, counts, monkeypatch):
    monkeypatch.setattr(expression, "GENES_A_TASK", 16)  # several blocks
    e, obs = frames
    got = {(r["dataset"], r["gene"]): r["score"] for r in expression.standardized_variance(e, obs, 0.9).collect()}
    for d, x in counts.items():
        want = plain_scores(x, 0.9)
        assert np.allclose([got.get((d, j), 0.0) for j in range(x.shape[1])], want, rtol=1e-7)
        assert got[d, 2] == 0  # constant
    assert got["a", 3] == pytest.approx(got["a", 4])
    top = expression.highly_variable_counts(e, obs, 5, 0.9).where("dataset = 'a'").orderBy("k").collect()
    scores = np.round(plain_scores(counts["a"], 0.9), 9)
    assert [r["gene"] for r in top] == sorted(range(40), key=lambda j: (-scores[j], j))[:5]


def dense_neighbours(obs, k):
    xy = np.array(obs)
    w = np.zeros((len(xy),) * 2)
    for i in range(len(xy)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        near = sorted((d[j], j) for j in range(len(xy)) if j != i)[:k]
        m = np.median([x for x, _ in near])
        for x, j in near:
            w[i, j] = np.exp(-((x / m) ** 2))
    return w / w.sum(1, keepdims=True)


def test_neighbour_matrix(frames, counts):
    e, obs = frames
    places = {d: [(r["x"], r["y"]) for r in obs.where(f"dataset = '{d}'").orderBy("obs_id").collect()] for d in counts}
    got = {(r["dataset"], r["obs_id"], r["part"], r["gene"]): r["value"] for r in expression.neighbour_matrix(e, obs, 6).collect()}
    for d, x in counts.items():
        near = dense_neighbours(places[d], 6) @ x
        kept = (x.var(0) > 1e-12) & (near.var(0) > 1e-12)
        for part, m, share in (("own", x, 0.8), ("neighbours", near, 0.2)):
            want = np.where(kept, m * np.sqrt(share) / np.where(kept, m.std(0), 1), 0)
            have = np.zeros_like(want)
            for (dd, i, p, j), v in got.items():
                if dd == d and p == part:
                    have[i, j] = v
            assert np.allclose(have, want) and not kept[1] and not kept[2]


def test_principal_components(frames, counts):
    e, obs = frames
    got = expression.principal_components(e, obs, 3).collect()
    for d, x in counts.items():
        pc = np.array([r["pc"] for r in sorted((r for r in got if r["dataset"] == d), key=lambda r: r["obs_id"])])
        u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
        assert pc.shape == (len(x), 3) and np.allclose(pc, (x - x.mean(0)) @ v[:3].T, atol=1e-6 * s[0])


def test_components_that_are_not_there(spark, frames):
    e, obs = frames
    flat = obs.where("dataset = 'b'").selectExpr("dataset", "obs_id", "1L AS gene", "cast(obs_id AS double) AS value")
    got = np.array([r["pc"] for r in expression.principal_components(flat, obs, 2).orderBy("dataset", "obs_id").collect()])
    assert np.allclose(got[90:, 0], np.arange(30) - 14.5) and np.allclose(got[90:, 1], 0, atol=1e-6) and np.allclose(got[:90], 0)
