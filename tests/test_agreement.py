from itertools import combinations
from math import comb, isclose

from hypothesis import given, settings
from hypothesis import strategies as st

from seedquorum.operators import agreement, pairs


def ari(x, y):
    """By counting pairs of observations."""
    same = [(x[i] == x[j], y[i] == y[j]) for i, j in combinations(range(len(x)), 2)]
    s, a, b, t = sum(p and q for p, q in same), sum(p for p, _ in same), sum(q for _, q in same), len(same)
    return 1.0 if s == a == b or (a + b) / 2 == a * b / t else (s - a * b / t) / ((a + b) / 2 - a * b / t)


def rows(spark, labels, refs):
    data = [("d", "m", s + 1, o, refs[o], c[o]) for s, c in enumerate(labels) for o in range(len(refs))]
    return spark.createDataFrame(data, "dataset string, method string, seed int, obs_id long, ref int, cluster int")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 2)), min_size=2, max_size=12))
def test_ari_by_pair_counts(spark, obs):
    x, y, ref = zip(*obs, strict=True)
    r = rows(spark, [x, y], ref)
    got = {g["seed"]: g["ari"] for g in agreement.seed_accuracy(r).collect()}
    assert isclose(got[1], ari(ref, x), abs_tol=1e-12) and isclose(got[2], ari(ref, y), abs_tol=1e-12)
    p = agreement.pair_agreement(r).collect()
    assert len(p) == 1 and isclose(p[0]["ari"], ari(x, y), abs_tol=1e-12)


def test_relabelling_is_perfect(spark):
    p = agreement.pair_agreement(rows(spark, [[0, 0, 1, 2], [5, 5, 7, 6]], [0, 0, 0, None])).first()
    assert p["ari"] == 1 and p["nmi"] == 1


def test_null_reference_is_left_out(spark):
    got = agreement.seed_accuracy(rows(spark, [[0, 0, 1, 1]], [0, 0, 1, None])).first()
    assert got["n_obs"] == 3 and got["ari"] == 1


def test_empty_runs(spark):
    r = rows(spark, [[0]], [0]).limit(0)
    assert agreement.seed_accuracy(r).count() == 0 and agreement.pair_agreement(r).count() == 0


def test_iso_summary_keeps_empty_units_and_the_boundary(spark):
    sp = spark.createDataFrame([("d", "a", 1, 2, 0.10, 0.12, 0.4, 0.02), ("d", "b", 1, 2, 0.1, 0.9, 0.4, 0.8)], "dataset string, method string, seed_r int, seed_s int, ari_r double, ari_s double, partition_ari double, abs_difference double")
    got = {(r["method"], r["threshold"]): r for r in pairs.iso_summary(sp, sp.select("dataset", "method")).collect()}
    assert got["a", 0.02]["n_iso_pairs"] == 1 and got["a", 0.02]["contains_divergent"] and got["a", 0.01]["n_iso_pairs"] == 0
    assert got["b", 0.03]["n_iso_pairs"] == 0 and got["b", 0.03]["median_partition_ari"] is None and len(got) == 6


def test_twenty_seeds_make_190_pairs(spark):
    assert agreement.pair_agreement(rows(spark, [[0, 1, s % 2] for s in range(20)], [0, 1, 1])).count() == comb(20, 2)
