"""Validation as queries: each returns the violations, so an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seedquorum.functions import scalar as S
from seedquorum.functions.canonical import canonical_json
from seedquorum.operators.relational import ValidationError, grid_audit, unused
from seedquorum.plans.workspace import Workspace


def schema_problems(df: DataFrame, required: list[str] | StructType) -> list[str]:
    """Missing columns; for a full schema also unexpected ones, order and types."""
    if not isinstance(required, StructType):
        return [f"missing {c}" for c in required if c not in df.columns]
    want, have = [(f.name, f.dataType.simpleString()) for f in required], [(f.name, f.dataType.simpleString()) for f in df.schema]
    return [] if want == have else [f"expected {w}" for w in want if w not in have] + [f"unexpected {h}" for h in have if h not in want] or ["order differs"]


def schema_ledger(df: DataFrame, required: list[str]) -> DataFrame:
    """problem, n: columns that are missing (and the rows that lack them), and nulls in those that are there."""
    have = [c for c in required if c in df.columns]
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(have)))
    rows = [F.struct(F.lit(f"missing {c}").alias("problem"), F.col("n").alias("n")) for c in required if c not in have]
    rows += [F.struct(F.lit(f"null in {c}").alias("problem"), F.col(f"c{i}").alias("n")) for i, c in enumerate(have)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0")


def require(problems: list[str]) -> None:
    if problems:
        raise ValidationError("; ".join(problems))


def not_finite(df: DataFrame, columns: list[str], unit_interval: bool = False) -> DataFrame:
    """column, n_bad: null, non-finite, or (asked for) outside 0..1."""
    bad = lambda c: ~S.finite(F.col(c)) | (~F.col(c).between(0, 1) if unit_interval else F.lit(False))
    one = df.agg(*(F.count_if(F.coalesce(bad(c), F.lit(True))).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in columns))).alias("r")).select("r.*").where("n_bad > 0")


def row_counts(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """table, n, expected of tables with another number of rows."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n", F.lit(n).cast("long").alias("expected")) for name, (df, n) in tables.items()]
    return reduce(DataFrame.unionByName, parts).where("n <> expected")


def rank_sums(distribution: DataFrame, winners: DataFrame, combos: int, scale: int) -> DataFrame:
    """Ranking tables whose counts, credits or probabilities don't add up."""
    a = distribution.groupBy("dataset", "method").agg(F.sum("combos").alias("v")).where(F.col("v") != combos).select("dataset", F.lit("combinations").alias("rule"), F.col("v").cast("double").alias("value"))
    b = winners.groupBy("dataset").agg(F.sum("credit").alias("v")).where(F.col("v") != combos * scale).select("dataset", F.lit("credit").alias("rule"), F.col("v").cast("double").alias("value"))
    c = winners.groupBy("dataset").agg(F.sum("p_rank1").alias("value")).where(F.abs(F.col("value") - 1) > 1e-12).select("dataset", F.lit("probability").alias("rule"), "value")
    return a.unionByName(b).unionByName(c)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], columns: dict[str, float]) -> DataFrame:
    """keys, column, left, right where two tables differ by more than the column's tolerance, or only one has the row or value."""
    l, r = left.select(*keys, F.struct(*columns).alias("l")), right.select(*keys, F.struct(*columns).alias("r"))
    both = l.join(r, keys, "full_outer")
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"l.{c}").cast("double").alias("left"), F.col(f"r.{c}").cast("double").alias("right"), F.lit(t).alias("t")) for c, t in columns.items()]
    out = both.select(*keys, F.explode(F.array(*parts)).alias("c")).select(*keys, "c.*")
    return out.where(F.col("left").isNull() != F.col("right").isNull()).unionByName(out.where(F.abs(F.col("left") - F.col("right")) > F.col("t"))).drop("t")


def not_constant(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Groups with more than one value."""
    return df.groupBy(*keys).agg(F.countDistinct(column).alias("n_values")).where("n_values > 1")


def names_by_dimension(df: DataFrame, dimension: DataFrame, key: str, name: str) -> DataFrame:
    """Names that aren't the dimension's for their key."""
    return df.select(key, name).distinct().join(dimension.select(key, F.col(name).alias("canonical")), key, "left").where(f"canonical IS NULL OR canonical <> {name}")


def run_audit(expected: DataFrame, found: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Every expected run with its state: absent, the first rule it breaks, or valid."""
    here = unused(found.columns, "_here")
    rows = expected.select(*keys).join(found.withColumn(here, F.lit(True)), keys, "left")
    state = F.when(F.col(here).isNull(), "absent")
    for name, ok in rules.items():
        state = state.when(~F.coalesce(ok, F.lit(False)), name)
    return rows.select(*keys, state.otherwise("valid").alias("state"))


def forbidden_tokens(lines: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """name, n_lines of patterns that occur."""
    one = lines.agg(*(F.count_if(F.col(column).rlike(p)).alias(n) for n, p in patterns.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n_lines")) for n in patterns))).alias("r")).select("r.*").where("n_lines > 0")


def table_digest(df: DataFrame, order: list[str], chunk: int = 10_000) -> DataFrame:
    """n_rows and a SHA-256 over rows as canonical JSON, in the given order: the digest of the digests of ``chunk`` rows each.

    Rows of equal order go by their JSON, so the digest doesn't depend on layout. A row's place comes from range partitions and their
    sizes; a task gathers one chunk's hex digests, the last step one line per chunk. An empty table has the digest of no lines.
    """
    work = Workspace(df.sparkSession, "digest")
    rows = df.select(F.struct(*order).alias("o"), canonical_json(F.struct(*df.columns)).alias("j"))
    rows = rows.repartitionByRange("o", "j").sortWithinPartitions("o", "j").select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.sha2(F.col("j").cast("binary"), 256).alias("d"))
    rows = work.write(rows, "rows")
    part = rows.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    part = part.select("p", "first", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row per partition
    placed = rows.join(part, "p").select((F.col("before") + F.col("i") - F.col("first")).alias("place"), "d")
    chunks = placed.groupBy(F.floor(F.col("place") / chunk).alias("c")).agg(F.count("*").alias("n"), S.digest(F.transform(F.sort_array(F.collect_list(F.struct("place", "d"))), lambda x: x["d"])).alias("d"))
    return chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), S.digest(F.transform(F.sort_array(F.collect_list(F.struct("c", "d"))), lambda x: x["d"])).alias("digest"))


def complete_grid(df: DataFrame, expected: DataFrame, keys: list[str]) -> None:
    require([f"{r['problem']}: {tuple(r[k] for k in keys)}" for r in grid_audit(df, expected, keys).limit(5).collect()])


def release_checks(seeds: DataFrame, pairs: DataFrame, iso: DataFrame, units: DataFrame, n_seeds: int, thresholds: int, primary: float = S.PRIMARY_ISO) -> DataFrame:
    """check, expected, found, passed of a study's tables before release: sizes that follow from the units, full units, and totals that two tables both give."""
    n = units.agg(F.count("*").alias("u"), F.countDistinct("dataset").alias("d"), F.countDistinct("method").alias("m"))
    full = lambda df, size: df.groupBy("dataset", "method").count().agg(F.count_if(F.col("count") == size).alias("f"), F.sum("count").alias("c"))
    a, b, c = full(seeds, n_seeds).toDF("sf", "sc"), full(pairs, n_seeds * (n_seeds - 1) // 2).toDF("pf", "pc"), full(iso, thresholds).toDF("if", "ic")
    first = iso.where(S.close(F.col("threshold"), primary)).agg(F.count("*").alias("one"), F.sum("n_iso_pairs").alias("eligible"), F.sum("n_divergent").alias("divergent"), F.count_if((F.col("n_divergent") > 0) != F.col("contains_divergent")).alias("odd"))
    one = n.crossJoin(a).crossJoin(b).crossJoin(c).crossJoin(first)  # one row each
    checks = {
        "units are a grid": ("d * m", "u"), "seeds": (f"u * {n_seeds}", "sc"), "full units of seeds": ("u", "sf"), "pairs": (f"u * {n_seeds * (n_seeds - 1) // 2}", "pc"), "full units of pairs": ("u", "pf"),
        "thresholds": (f"u * {thresholds}", "ic"), "primary threshold": ("u", "one"), "divergent flags": ("0", "odd"), "divergent pairs are eligible": ("least(divergent, eligible)", "divergent"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), F.expr(e).cast("long").alias("expected"), F.expr(f"`{v}`").cast("long").alias("found")) for k, (e, v) in checks.items()))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("passed", F.col("expected") == F.col("found"))
