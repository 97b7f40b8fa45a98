import collections
import math
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedquorum.functions import scalar as S
from seedquorum.operators import agreement, consensus, expression, graph, markers, ranking, relational, spatial, stats, validate
from seedquorum.sources import files, sinks
from seedquorum.streaming import live


def test_ranking_matches_listing(spark):
    rng = np.random.default_rng(1)
    v = {m: [round(float(x), 1) for x in rng.random(3)] for m in "abcde"}
    scores = spark.createDataFrame([("d", m, i, x) for m, xs in v.items() for i, x in enumerate(xs)], "dataset string, method string, seed int, ari double")
    want, credit = {}, dict.fromkeys(v, 0)
    for combo in product(*v.values()):
        for m, x in zip(v, combo, strict=True):
            g, t = sum(y > x for y in combo), sum(y == x for y in combo) - 1
            want[m, 2 + 2 * g + t] = want.get((m, 2 + 2 * g + t), 0) + 1
            credit[m] += 60 // (t + 1) if g == 0 else 0
    got = {(r["method"], r["rank_x2"]): r["combos"] for r in ranking.rank_distribution(scores).collect()}
    assert {k: n for k, n in got.items() if n} == want and len(got) == 45
    assert {r["method"]: r["credit"] for r in ranking.winner_probability(scores).collect()} == credit
    assert validate.rank_sums(ranking.rank_distribution(scores), ranking.winner_probability(scores), 243, 60).count() == 0


def test_signed_rank(spark):
    d = spark.createDataFrame([(float(i), 0.0) for i in (1, 2, 3, -4, 5, 6)], "a double, b double")
    r = stats.signed_rank(d, "a", "b").first()
    want = sum(sum(k for k, s in zip(range(1, 7), signs, strict=True) if s) >= 17 for signs in product((0, 1), repeat=6)) / 64
    assert r["w_plus"] == 17 and r["p"] == want and math.isclose(r["rank_biserial"], 13 / 21)


def test_signed_rank_normal_with_ties(spark):
    d = spark.createDataFrame([(float(1 + i % 3), 0.0) for i in range(60)] + [(0.0, 0.0)], "a double, b double")
    r = stats.signed_rank(d, "a", "b").first()
    assert r["n"] == 60 and r["n_zero"] == 1 and r["p"] < 1e-10


def test_spearman_is_null_on_constants(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 5.0), ("b", None, 5.0)], "k string, x double, y double")
    got = {r["k"]: r["spearman"] for r in stats.spearman(d, ["k"], "x", "y").collect()}
    assert got["a"] is None and math.isclose(got["b"], 1)


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (2, 4), (4, 5)):
        for _ in range(20):
            o = rng.integers(0, 9, (n, m))
            a = consensus.assignment(o)
            assert len(set(a)) == n and o[np.arange(n), a].sum() == max(o[np.arange(n), list(c)].sum() for c in permutations(range(m), n))


def test_alignment_modes(spark):
    p = spark.createDataFrame([("u", 0, 7), ("u", 0, 7), ("u", 1, 8), ("u", 2, 8), ("u", 2, 8)], "k string, source int, target int")
    got = {r["source"]: r["aligned"] for r in consensus.align(p, ["k"]).collect()}
    assert got == {"0": "7", "1": "8", "2": "8"}
    assert {r["source"]: r["aligned"] for r in consensus.align(p, ["k"], unmatched="Unmatched").collect()}["1"] == "Unmatched"
    with pytest.raises(Exception, match="3 sources for 2 targets"):
        consensus.align(p, ["k"], strict=True).collect()


def test_support_counts_members(spark):
    runs = spark.createDataFrame([("d", "m", s, o, c) for s, cs in enumerate([(0, 0, 1), (0, 1, 1)]) for o, c in enumerate(cs)], "dataset string, method string, seed int, obs_id long, cluster int")
    part = spark.createDataFrame([("d", "m", o, c) for o, c in enumerate((0, 0, 1))], "dataset string, method string, obs_id long, cluster int")
    assert {r["obs_id"]: r["support"] for r in consensus.support(runs, part).collect()} == {0: 0.5, 1: 0.5, 2: 1.0}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 40, (30, 2))]
    up = {i: i for i in range(40)}

    def find(i):
        return i if up[i] == i else find(up[i])

    for a, b in e:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in {x for a, b in e if a != b for x in (a, b)}}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.random((60, 2)), [[9, 9], [9, 9]]])
    p = spark.createDataFrame([("d", i, float(x), float(y), i % 2) for i, (x, y) in enumerate(xy)], "dataset string, obs_id long, x double, y double, label int")
    got = {(r["src"], r["rank"]): r["dst"] for r in spatial.nearest(p, 3).collect()}
    for i in range(62):
        order = sorted((math.dist(xy[i], xy[j]), j) for j in range(62) if j != i)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in order]


def test_rank_sum_over_implicit_zeros(spark):
    runs = spark.createDataFrame([("d", "m", 1, o, o % 2) for o in range(4)], "dataset string, method string, seed int, obs_id long, cluster int")
    e = spark.createDataFrame([("d", 0, 1, 2.0), ("d", 2, 1, 1.0), ("d", 1, 2, 3.0)], "dataset string, obs_id long, gene long, value double")
    got = {(r["domain"], r["gene"]): r["z"] for r in markers.rank_sum_markers(e, runs).collect()}
    # ranks of gene 1: zeros share 1.5, then 3 and 4: domain 0 has 7, expected 5
    assert math.isclose(got[0, 1], 2 / math.sqrt(2 * 2 * 5 / 12), abs_tol=1e-8) and got[1, 1] == -got[0, 1] and got[1, 2] > 0


def test_preprocessing(spark):
    e = spark.createDataFrame([("d", o, g, float(1 + (o * g) % 5)) for o in range(12) for g in range(4)], "dataset string, obs_id long, gene long, value double")
    obs = e.select("dataset", "obs_id").distinct()
    assert abs(expression.normalize_total(e, 10).groupBy("obs_id").agg(F.sum("value").alias("t")).first()["t"] - 10) < 1e-9
    m = np.array([[1 + (o * g) % 5 for g in range(4)] for o in range(12)], float)
    got = {r["gene"]: r["variance"] for r in expression.gene_moments(e, obs).collect()}
    assert np.allclose([got[g] for g in range(4)], m.var(0, ddof=1))
    assert expression.highly_variable(e, obs, 2).count() == 2 and expression.scale(e, obs).agg(F.max("value")).first()[0] <= 10


def test_relational_checks(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "z"), (1, "w")], "k int, v string")
    with pytest.raises(relational.ValidationError):
        relational.join_one_to_one(a, b, ["k"])
    with pytest.raises(relational.ValidationError):
        relational.lookup(a, b.where("k = 5"), ["k"], strict=True)
    assert {(r["k"], r["problem"]) for r in relational.grid_audit(b, spark.createDataFrame([(1,), (3,)], "k int"), ["k"]).collect()} == {(3, "missing"), (1, "repeated")}
    assert relational.back_filter(a, a, ["k"]).count() == 0
    assert validate.not_finite(spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,)], "x double"), ["x"], unit_interval=True).first()["n_bad"] == 3
    assert validate.reconcile(a.selectExpr("k", "1.0D AS x"), a.selectExpr("k", "1.0000001D AS x"), ["k"], {"x": 1e-6}).count() == 0


def test_scalar_parsing(spark):
    d = spark.createDataFrame([(" True ", "2024-01-01T00:00:00Z", 0.0299999999999999, "1e3")], "b string, t string, x double, n string")
    r = d.select(S.parse_boolean(F.col("b")).alias("b"), S.parse_timestamp(F.col("t")).alias("t"), S.snap(F.col("x"), tolerance=1e-15).alias("x"), S.number(F.col("n")).alias("n")).first()
    assert r["b"] is True and r["t"] is not None and r["x"] == 0.03 and r["n"] == 1000
    with pytest.raises(Exception, match="no time zone"):
        d.select(S.parse_timestamp(F.lit("2024-01-01T00:00:00"))).collect()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿section,x\n151507,1.5\n0042,NA\n", encoding="utf-8")
    d = files.read_csv(spark, str(tmp_path / "a.csv"), "section string, x double", null="NA")
    assert [tuple(r) for r in d.collect()] == [("151507", 1.5), ("0042", None)]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n2 2 2\n1 1 3.5\n2 1 2\n")
    assert {tuple(r) for r in files.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()} == {(1, 1, 3.5), (2, 1, 2.0)}
    np.savez(tmp_path / "e.npz", z=np.eye(2))
    assert files.read_arrays(spark, str(tmp_path / "e.npz"), "z").count() == 2
    assert sinks.formatted(spark.createDataFrame([(0.1 + 0.2,), (1e-9,), (2.0,), (None,)], "x double"), 10).toPandas().x.tolist() == ["0.3", "1e-09", "2", None]
    with pytest.raises(relational.ValidationError):
        files.read_tokens(spark, str(tmp_path / "a.csv"), ["section"]).unionAll(d.selectExpr("section", "'1'")) and files.single_match(spark, str(tmp_path / "*.none"))


def test_csv_comes_back_as_it_was(spark, tmp_path):
    cells = ['a"b', "", " sp ", "x,y", "two\nlines", "cr\rend", "\\", '\\"', None, "NA", '""', "é\t", "'", "#c"]
    d = spark.createDataFrame([(i, c, c) for i, c in enumerate(cells)], "k int, a string, b string")
    for name, null, sep in (("plain", "", ","), ("na", "none", ","), ("tabs", "", "\t")):
        sinks.write_csv(d, path := f"{tmp_path}/{name}", null=null, sep=sep, bom=name == "na")
        got = files.read_csv(spark, path, "k int, a string, b string", null=null, sep=sep, multi_line=True).orderBy("k").collect()
        assert [(r["a"], r["b"]) for r in got] == [(c, c) for c in cells], name


def test_digits_are_those_of_c(spark):
    values = [123456789012.5, 0.1 + 0.2, -0.0, 1e-9, 2.0, 0.1234567890125, 1e22, 123456789013.5, float("inf"), 5e-324, 1234567890125e-13, None, float("nan")]
    got = sinks.formatted(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double"), 12).orderBy("i").collect()
    assert [r["x"] for r in got] == [None if v is None or v != v else "%.12g" % v for v in values]


def test_stream_scores_what_has_come(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("d", "m", 1, o, o % 2, o % 2) for o in range(6)], "dataset string, method string, seed int, obs_id long, ref int, cluster int").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = live.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["ari"] == 1.0


def test_nearest_with_an_outlier(spark):
    """A point a million times further out than the rest changes nothing for them."""
    r = np.random.default_rng(3)
    xy = [*map(tuple, r.random((200, 2))), (1e6, 1e6)]
    p = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "dataset string, obs_id long, x double, y double")
    got = {(x["src"], x["rank"]): x["dst"] for x in spatial.nearest(p, 3).collect()}
    a = np.array(xy)
    for i in range(len(a)):
        d = np.sqrt(((a - a[i]) ** 2).sum(1))
        best = sorted((d[j], j) for j in range(len(a)) if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in best]


def test_digest_follows_the_order(spark):
    df = spark.createDataFrame([(k, -k) for k in range(50)], "k int, v int")
    digest = lambda d, o: validate.table_digest(d, o, 7).first()["digest"]
    assert digest(df, ["k"]) == digest(df.repartition(5), ["k"]) != digest(df, ["v"])
    assert validate.table_digest(df.limit(0), ["k"]).first()["n_rows"] == 0


def test_lookup_keys_are_unique(spark):
    base, other = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(relational.ValidationError):
        relational.lookup(base, other, ["k"])


def test_pair_agreement_of_null_labels_and_gaps(spark):
    """Labels of any number; a null is a label; observations that a seed lacks don't count for its pairs."""
    r = np.random.default_rng(1)
    rows = [("d", "m", s, i, None if r.random() < 0.1 else f"c{r.integers(0, 30)}") for s in range(4) for i in range(80) if r.random() < 0.9]
    got = {(x["seed_r"], x["seed_s"]): x for x in agreement.pair_agreement(spark.createDataFrame(rows, "dataset string, method string, seed int, obs_id int, cluster string")).collect()}
    of = {(s, i): c for _, _, s, i, c in rows}
    pairs = lambda c: sum(n * (n - 1) / 2 for n in c.values())
    for a in range(4):
        for b in range(a + 1, 4):
            both = [(of[a, i], of[b, i]) for i in range(80) if (a, i) in of and (b, i) in of]
            n, x, y, z = len(both), collections.Counter(both), collections.Counter(p for p, _ in both), collections.Counter(q for _, q in both)
            e = pairs(y) * pairs(z) / (n * (n - 1) / 2)
            assert got[a, b]["n_obs"] == n and abs(got[a, b]["ari"] - (pairs(x) - e) / ((pairs(y) + pairs(z)) / 2 - e)) < 1e-12


def test_assessment_labels(spark):
    from seedquorum.operators import pairs

    def overall(**counts):
        d = spark.createDataFrame([(k, *v) for k, v in counts.items()], "component string, yes long, n long")
        rows = {r["component"]: (r["label"], r["overall"]) for r in pairs.component_labels(d).collect()}
        return [rows[k][0].split("_")[0] for k in counts], next(iter(rows.values()))[1].split("_")[0]

    core = {"score_map_decoupling": (3, 3), "iso_accuracy_map_divergence": (3, 3)}
    assert overall(**core, a=(3, 3), b=(2, 2), c=(1, 3)) == (["SUPPORTS"] * 4 + ["HETEROGENEOUS"], "STRONG")
    assert overall(**core, a=(3, 3), b=(2, 2), c=(0, 3))[1] == "PARTIAL"
    assert overall(**core, a=(0, 0), b=(1, 2), c=(1, 3)) == (["SUPPORTS"] * 2 + ["NOT", "HETEROGENEOUS", "HETEROGENEOUS"], "PARTIAL")
    assert overall(score_map_decoupling=(0, 3), iso_accuracy_map_divergence=(0, 3), a=(3, 3), b=(3, 3), c=(3, 3))[1] == "CONTRASTING"
    assert overall(score_map_decoupling=(1, 3), iso_accuracy_map_divergence=(0, 3), a=(3, 3))[1] == "LIMITED"
    counts = pairs.component_counts({"x": spark.createDataFrame([(True,), (False,), (None,)], "flag boolean")}).first()
    assert (counts["yes"], counts["n"]) == (1, 2)


def test_marker_universe_problems(spark):
    rows = [("a", g, True) for g in range(3)] + [("b", 1, True), ("b", 1, True), ("b", 2, True)] + [("c", 1, False), ("c", 2, None)] + [("d", 1, True), ("d", 2, False)]
    kept, bad = expression.marker_universe(spark.createDataFrame(rows, "dataset string, gene int, flagged boolean"), 2, {"a": 4})
    assert {tuple(r) for r in bad.collect()} == {("a", "not 4", 3), ("b", "repeated genes", 1), ("c", "unknown flags", 1), ("c", "empty", 0), ("d", "too few", 1)}
    assert kept.count() == 7


def test_release_checks_and_order(spark):
    seeds = spark.createDataFrame([(d, "m", s) for d in "ab" for s in range(3)], "dataset string, method string, seed int")
    pairs_ = spark.createDataFrame([(d, "m", i) for d in "ab" for i in range(3 if d == "a" else 2)], "dataset string, method string, i int")
    iso = spark.createDataFrame([(d, "m", t, 2, int(t > 0.015), t > 0.015) for d in "ab" for t in (0.01, 0.02)], "dataset string, method string, threshold double, n_iso_pairs long, n_divergent long, contains_divergent boolean")
    units = seeds.select("dataset", "method").distinct()
    got = {r["check"]: r["passed"] for r in validate.release_checks(seeds, pairs_, iso, units, 3, 2).collect()}
    assert {k for k, v in got.items() if not v} == {"pairs", "full units of pairs"}
    base = spark.createDataFrame([(3, "x"), (1, "z"), (2, "y")], "place int, k string")
    assert [tuple(r) for r in relational.reindex(base, spark.createDataFrame([("x", 7), ("y", 8)], "k string, v int"), ["k"], "place").select("k", "v").collect()] == [("z", None), ("y", 8), ("x", 7)]


def test_helpers_leave_clashing_names_alone(spark):
    d = spark.createDataFrame([(1, 5, "p", 0), (1, 6, "q", 1), (2, 7, "r", 2)], "k int, _k int, _here string, _o0 int")
    assert {tuple(r) for r in relational.first_per_group(d, ["k"], [F.desc("_k")]).collect()} == {(1, 6, "q", 1), (2, 7, "r", 2)}
    assert {r["state"] for r in validate.run_audit(d.select("k"), d, ["k"], {"low": F.col("_here") != "q"}).collect()} == {"valid", "low"}
    order = spark.createDataFrame([(1, 2), (2, 1)], "k int, place int")
    assert [r["_o0"] for r in relational.ordered_union([d], [(order, "k", "place")], ["_o0"]).collect()] == [2, 0, 1]
    a = spark.createDataFrame([(1, 2)], "a int, v int")
    assert [tuple(r) for r in relational.full_outer_audit(a, a, "a", "v").collect()] == [(1, "same")]
