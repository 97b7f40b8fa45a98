"""Nested JSON documents against a declared schema: one ledger of violations, and flat tables.

A document is parsed once, into a variant. Every rule is compiled to column expressions over it, and its violations are rows (key, rule,
path, found); ``[*]`` in a path stands for each element of an array. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedquorum.operators.relational import unused

#: A rule's test of the value at its path: (variant that holds it, path within, value as text) -> whether it is violated.
Test = Callable[[Column, str, Column], Column]
_FOUND = "array<struct<rule:string,path:string,found:string>>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    """number, string, boolean, object, array or null; NULL where nothing is."""
    s = F.schema_of_variant(_get(v, path, "variant"))
    return F.when(s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "VOID", "null").otherwise(F.lower(s))


@dataclass(frozen=True)
class Rule:
    """A named test of a path. ``optional``: only where something other than null is there."""

    name: str
    path: str
    bad: Test = field(repr=False)
    optional: bool = False

    def violations(self, doc: Column) -> Column:
        head, star, rest = self.path.partition("[*]")

        def one(v: Column, path: str, place: Column) -> Column:
            there = _kind(v, path)
            broken = F.coalesce(self.bad(v, path, _get(v, path, "string")), F.lit(True))
            if self.optional:
                broken = broken & there.isNotNull() & (there != "null")
            return F.when(broken, F.struct(F.lit(self.name).alias("rule"), place.alias("path"), _get(v, path, "string").alias("found")))

        if not star:
            return F.array(one(doc, self.path, F.lit(self.path)))
        items = F.coalesce(_get(doc, head, "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(items, lambda x, i: one(x, f"${rest}", F.concat(F.lit(f"{head}["), i.cast("string"), F.lit(f"]{rest}"))))


def required(path: str) -> Rule:
    """Something is there, if only null."""
    return Rule("required", path, lambda v, p, _: _get(v, p, "variant").isNull())


def has_type(path: str, kind: str, optional: bool = False) -> Rule:
    """number, string, boolean, object, array or null."""
    return Rule("type", path, lambda v, p, _: _kind(v, p) != kind, optional)


def in_range(path: str, low: float | None = None, high: float | None = None, whole: bool = False, optional: bool = False) -> Rule:
    """A finite number within both ends; ``whole``: without a fraction."""

    def bad(v: Column, p: str, _: Column) -> Column:
        x = _get(v, p, "double")
        broken = (_kind(v, p) != "number") | F.isnan(x) | (F.abs(x) == float("inf"))
        if low is not None:
            broken = broken | (x < low)
        if high is not None:
            broken = broken | (x > high)
        return broken | (x != F.floor(x)) if whole else broken

    return Rule("range", path, bad, optional)


def one_of(path: str, *values: str, optional: bool = False) -> Rule:
    return Rule("value", path, lambda v, p, t: ~t.isin(*values), optional)


def matches(path: str, pattern: str, optional: bool = False) -> Rule:
    return Rule("pattern", path, lambda v, p, t: (_kind(v, p) != "string") | ~t.rlike(pattern), optional)


def same(path: str, other: str) -> Rule:
    """Both places hold the same plain value."""
    return Rule("same", path, lambda v, p, t: ~t.eqNullSafe(_get(v, other, "string")))


def keys(path: str, *names: str) -> list[Rule]:
    """Each name is a key of the object at a path."""
    return [required(f"{path}.{n}") for n in names]


def violation_ledger(docs: DataFrame, key: list[str], text: str, rules: list[Rule]) -> DataFrame:
    """key, rule, path, found of every violation; a text that is no JSON (or null) violates the rule ``json`` alone."""
    kinds = dict(docs.dtypes)
    at = [f"k{i}" for i in range(len(key))]
    d = docs.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(key, at, strict=True)), F.col(f"`{text}`").alias("text"), F.try_parse_json(F.col(f"`{text}`")).alias("doc"))
    whole = F.array(F.struct(F.lit("json").alias("rule"), F.lit("$").alias("path"), F.substring("text", 1, 40).alias("found")))
    every = F.filter(F.concat(*(r.violations(F.col("doc")).cast(_FOUND) for r in rules)), lambda x: x.isNotNull())
    rows = d.select(*at, F.explode(F.when(F.col("doc").isNull(), whole.cast(_FOUND)).otherwise(every)).alias("x"))
    return rows.select(*(F.col(a).cast(kinds[k]).alias(k) for k, a in zip(key, at, strict=True)), "x.rule", "x.path", "x.found")


def flatten(docs: DataFrame, keep: list[str], text: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``keep`` and a column per entry, name -> (path, type); what is absent or no such value is NULL."""
    doc = unused(keep, "_doc")
    d = docs.select(*(F.col(f"`{k}`") for k in keep), F.try_parse_json(F.col(f"`{text}`")).alias(doc))
    return d.select(*(F.col(f"`{k}`") for k in keep), *(_get(F.col(doc), path, kind).alias(name) for name, (path, kind) in columns.items()))


#: The keys that a run's checkpoint document must have, by the place of their object.
CHECKPOINT_KEYS: dict[str, tuple[str, ...]] = {
    "$": (
        "schema_version", "status", "mode", "dataset", "seed", "requested_k", "observed_k", "protocol_hash", "input", "implementation", "parameters", "preprocessing", "graph",
        "training", "final_readout", "outputs", "runtime_seconds", "resources", "environment", "compatibility",
    ),
    "$.input": ("technical_path", "bytes", "sha256", "obs_count", "var_count", "obs_order_sha256_newline_utf8"),
    "$.final_readout": ("labels_count", "labels_finite", "model", "calls", "requested_k", "observed_k"),
    "$.outputs": ("labels_path", "labels_bytes", "labels_sha256", "embedding_path", "embedding_bytes", "embedding_sha256", "embedding_shape", "embedding_finite"),
    "$.parameters": ("platform_regime", "graph_k", "requested_k", "target_sum", "pca_random_state", "pretraining_epochs", "dec_epochs", "internal_dec_k", "model_mode"),
    "$.preprocessing": ("retained_gene_count", "pca_dimension", "finite"),
    "$.graph": ("k", "edge_count", "isolates", "connected_components"),
    "$.training": ("completed", "pretraining_epochs_completed", "dec_epochs_completed", "embedding_shape", "embedding_finite"),
}

#: The flat columns of a checkpoint document.
CHECKPOINT_COLUMNS: dict[str, tuple[str, str]] = {
    "dataset": ("$.dataset", "string"), "seed": ("$.seed", "bigint"), "status": ("$.status", "string"), "mode": ("$.mode", "string"), "requested_k": ("$.requested_k", "bigint"), "observed_k": ("$.observed_k", "bigint"),
    "n_obs": ("$.input.obs_count", "bigint"), "n_vars": ("$.input.var_count", "bigint"), "retained_gene_count": ("$.preprocessing.retained_gene_count", "bigint"), "pca_dimension": ("$.preprocessing.pca_dimension", "bigint"),
    "graph_k": ("$.graph.k", "bigint"), "graph_edge_count": ("$.graph.edge_count", "bigint"), "graph_isolates": ("$.graph.isolates", "bigint"), "graph_connected_components": ("$.graph.connected_components", "bigint"), "graph_sha256": ("$.graph.hash", "string"),
    "pretraining_epochs_completed": ("$.training.pretraining_epochs_completed", "bigint"), "dec_epochs_completed": ("$.training.dec_epochs_completed", "bigint"), "embedding_shape": ("$.training.embedding_shape", "array<string>"), "embedding_finite": ("$.training.embedding_finite", "boolean"),
    "labels_count": ("$.final_readout.labels_count", "bigint"), "labels_finite": ("$.final_readout.labels_finite", "boolean"), "final_readout_model": ("$.final_readout.model", "string"), "final_readout_calls": ("$.final_readout.calls", "bigint"),
    "runtime_seconds": ("$.runtime_seconds", "double"), "peak_ram_gib": ("$.resources.peak_ram_gib", "double"), "peak_gpu_memory_mib": ("$.resources.peak_gpu_memory_mib", "double"), "protocol_sha256": ("$.protocol_hash", "string"),
    "input_sha256": ("$.input.sha256", "string"), "input_manifest_sha256": ("$.input.manifest_sha256", "string"), "labels_sha256": ("$.outputs.labels_sha256", "string"),
}

HASH = "^[0-9A-Fa-f]{64}$"


def checkpoint_rules() -> list[Rule]:
    """A run's checkpoint: all keys, then what their values have to be."""
    return [
        *(r for path, names in CHECKPOINT_KEYS.items() for r in keys(path, *names)),
        one_of("$.status", "complete"), in_range("$.seed", 1, whole=True), in_range("$.requested_k", 1, whole=True), in_range("$.observed_k", 1, whole=True), matches("$.protocol_hash", HASH),
        matches("$.input.sha256", HASH), in_range("$.input.obs_count", 1, whole=True), in_range("$.input.var_count", 1, whole=True), in_range("$.preprocessing.retained_gene_count", 1, whole=True), one_of("$.preprocessing.finite", "true"),
        in_range("$.graph.isolates", 0, whole=True), one_of("$.training.completed", "true"), one_of("$.training.embedding_finite", "true"), one_of("$.final_readout.labels_finite", "true"), in_range("$.final_readout.calls", 1, 1, whole=True),
        in_range("$.training.embedding_shape[*]", 1, whole=True), in_range("$.runtime_seconds", 0), matches("$.outputs.labels_sha256", HASH), same("$.final_readout.requested_k", "$.requested_k"), same("$.final_readout.observed_k", "$.observed_k"),
        same("$.parameters.requested_k", "$.requested_k"), same("$.final_readout.labels_count", "$.input.obs_count"), same("$.graph.k", "$.parameters.graph_k"),
    ]


def checkpoint_table(docs: DataFrame, text: str, digest: Column) -> DataFrame:
    """The flat columns of checkpoint documents: shapes joined by x, and the document's own digest."""
    out = flatten(docs.withColumn("checkpoint_sha256", digest), ["checkpoint_sha256"], text, CHECKPOINT_COLUMNS)
    return out.select(*CHECKPOINT_COLUMNS, "checkpoint_sha256").withColumn("embedding_shape", F.array_join("embedding_shape", "x"))
