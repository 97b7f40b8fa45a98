"""Canonical JSON against Python's encoder; planted faults of nested documents, by rule and path."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from seedquorum.functions.canonical import canonical_digest, canonical_json
from seedquorum.operators import documents as D

H = "a" * 64


def good():
    return {
        "schema_version": 1, "status": "complete", "mode": "m", "dataset": "d", "seed": 3, "requested_k": 5, "observed_k": 4, "protocol_hash": H, "implementation": {}, "environment": {}, "compatibility": None, "runtime_seconds": 1.5,
        "input": {"technical_path": "p", "bytes": 1, "sha256": H, "obs_count": 10, "var_count": 7, "obs_order_sha256_newline_utf8": H, "manifest_sha256": H}, "resources": {"peak_ram_gib": 0.5, "peak_gpu_memory_mib": None},
        "parameters": {"platform_regime": "spot", "graph_k": 6, "requested_k": 5, "target_sum": 1e6, "pca_random_state": 42, "pretraining_epochs": 2, "dec_epochs": 2, "internal_dec_k": 3, "model_mode": "x"},
        "preprocessing": {"retained_gene_count": 7, "pca_dimension": 3, "finite": True}, "graph": {"k": 6, "edge_count": 30, "isolates": 0, "connected_components": 1, "hash": H},
        "training": {"completed": True, "pretraining_epochs_completed": 2, "dec_epochs_completed": 2, "embedding_shape": [10, 3], "embedding_finite": True},
        "final_readout": {"labels_count": 10, "labels_finite": True, "model": "EEE", "calls": 1, "requested_k": 5, "observed_k": 4},
        "outputs": {"labels_path": "l", "labels_bytes": 2, "labels_sha256": H, "embedding_path": "e", "embedding_bytes": 3, "embedding_sha256": H, "embedding_shape": [10, 3], "embedding_finite": True},
    }


def broken(path, value="gone"):
    d = copy.deepcopy(good())
    at = d
    for k in path[:-1]:
        at = at[k]
    if value == "gone":
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return d


FAULTS = [
    (good(), set()),
    (broken(["mode"]), {("required", "$.mode")}),
    (broken(["graph"]), {("required", "$.graph"), *(("required", f"$.graph.{k}") for k in D.CHECKPOINT_KEYS["$.graph"]), ("range", "$.graph.isolates"), ("same", "$.graph.k")}),
    (broken(["seed"], 2.5), {("range", "$.seed")}),
    (broken(["seed"], "3"), {("range", "$.seed")}),
    (broken(["status"], "failed"), {("value", "$.status")}),
    (broken(["protocol_hash"], H[1:]), {("pattern", "$.protocol_hash")}),
    (broken(["training", "embedding_shape"], [10, 0, -1]), {("range", "$.training.embedding_shape[1]"), ("range", "$.training.embedding_shape[2]")}),
    (broken(["final_readout", "labels_count"], 9), {("same", "$.final_readout.labels_count")}),
    (broken(["runtime_seconds"], None), {("range", "$.runtime_seconds")}),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, json.dumps(d), 1) for i, (d, _) in enumerate(FAULTS)] + [(90, "{no json", 1), (91, None, 1)]
    return spark.createDataFrame(rows, "k int, text string, rule int")


def test_planted_faults(docs):
    got = {}
    for r in D.violation_ledger(docs, ["k"], "text", D.checkpoint_rules()).collect():
        got.setdefault(r["k"], set()).add((r["rule"], r["path"]))
    want = {i: f for i, (_, f) in enumerate(FAULTS) if f} | {90: {("json", "$")}, 91: {("json", "$")}}
    assert got == want


def test_optional_and_types(spark):
    rows = [(0, '{"a": {"b": [{"c": 1}, {"c": "x"}, {}]}}'), (1, '{"a": {"b": {}}}'), (2, "[]"), (3, '{"a": null}')]
    docs = spark.createDataFrame(rows, "`k.k` int, t string")
    rules = [D.has_type("$.a.b[*].c", "number", optional=True), D.has_type("$.a", "object"), D.one_of("$.a.z", "1", optional=True)]
    got = {(r[0], r["rule"], r["path"], r["found"]) for r in D.violation_ledger(docs, ["k.k"], "t", rules).collect()}
    assert got == {(0, "type", "$.a.b[1].c", "x"), (2, "type", "$.a", None), (3, "type", "$.a", None)}


def test_flat_table(docs):
    got = D.checkpoint_table(docs.where("k = 0"), "text", F.upper(F.sha2("text", 256)))
    row = got.first().asDict()
    assert len(row) == 31 and row["embedding_shape"] == "10x3" and row["seed"] == 3 and row["peak_gpu_memory_mib"] is None and row["graph_sha256"] == H and row["runtime_seconds"] == 1.5
    assert D.checkpoint_table(docs.where("k = 90"), "text", F.lit("x")).first()["seed"] is None


def test_canonical_json(spark):
    floats = [1e22, 1e16, 123456789012345680.0, 1e-5, 0.1 + 0.2, 5e-324, 2e-44, -0.0, 1.0, float("nan"), float("inf"), None, 2.0**-44, 9007199254740993.0]
    rows = [(x, [x, 1.5], {"é": "ü\n\"\\ 😀", "a": "/"}, (2, None, {"z": [x], "b": []}), True, 2**53 + 1) for x in floats]
    schema = "f double, a array<double>, `m` map<string,string>, s struct<z:int, `A b`:string, m:map<string,array<double>>>, t boolean, n long"
    d = spark.createDataFrame(rows, schema)
    got = d.select(canonical_json(F.struct("*")).alias("j"), canonical_digest(F.struct("*")).alias("d")).collect()
    for r, (f, a, m, s, t, n) in zip(got, rows, strict=True):
        want = json.dumps({"f": f, "a": a, "m": m, "s": {"z": s[0], "A b": s[1], "m": s[2]}, "t": t, "n": n}, sort_keys=True, separators=(",", ":"))
        assert r["j"] == want and r["d"] == hashlib.sha256(want.encode()).hexdigest().upper()
    assert spark.range(1).select(canonical_json(F.lit(None).cast("double")).alias("j")).first()["j"] == "null"
