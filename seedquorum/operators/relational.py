"""Relational steps with their checks: validated joins, grids, ordered unions, pivots, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """A table broke a stated rule."""


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it (upper and lower case alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def require_unique(df: DataFrame, keys: list[str], what: str = "key") -> DataFrame:
    bad = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if bad:
        raise ValidationError(f"{what} repeats: {[tuple(r[k] for k in keys) for r in bad]}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join whose keys are unique on both sides; clashing other columns get suffixes."""
    require_unique(left, on, "left key")
    return join_many_to_one(left, right, on, how, suffixes)


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    require_unique(right, on, "right key")
    clash = (set(left.columns) & set(right.columns)) - set(on)
    rename = lambda df, s: df.withColumnsRenamed({c: c + s for c in clash})
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), on, how)


def chain(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Inner one-to-one join of several tables."""
    out = frames[0]
    for f in frames[1:]:
        out = join_one_to_one(out, f, on)
    return out


def require_columns(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """Fails while running if any of the columns is null."""
    bad = " OR ".join(f"{c} IS NULL" for c in columns)
    return df.where(F.coalesce(F.when(F.expr(bad), F.raise_error(F.lit(f"null in {columns}")).cast("boolean")), F.lit(True)))


def lookup(base: DataFrame, other: DataFrame, on: list[str], strict: bool = False) -> DataFrame:
    """``other``'s columns for every row of ``base``; missing ones are NULL, or, strict, an error. ``other``'s keys have to be unique."""
    require_unique(other, on, "lookup key")
    if strict and (missing := base.join(other, on, "left_anti").select(*on).limit(3).collect()):
        raise ValidationError(f"not found: {[tuple(r) for r in missing]}")
    return base.join(other, on, "left")


def reindex(base: DataFrame, other: DataFrame, on: list[str], order: str) -> DataFrame:
    """``other``'s columns for every row of ``base``, NULL where it has none, in the order of ``base``'s column."""
    return lookup(base, other, on).orderBy(order)


def map_column(df: DataFrame, source: str, target: str, mapping: dict, fallback: Column | None = None) -> DataFrame:
    """A literal dictionary as a column; without a fallback unknown keys are NULL."""
    m = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    v = F.try_element_at(m, F.col(source))
    return df.withColumn(target, F.coalesce(v, fallback) if fallback is not None else v)


def align_schema(df: DataFrame, like: DataFrame, rename: dict[str, str] | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Rename, derive, then exactly the columns of ``like`` in its order and types; absent ones are NULL."""
    df = df.withColumnsRenamed(rename or {}).withColumns(derived or {})
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def ordered_union(parts: list[DataFrame], dimensions: list[tuple[DataFrame, str, str]], then: list[str] = ()) -> DataFrame:
    """Union by name in the order of dimension tables (frame, key, order column)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    names = out.columns
    keys = []
    for i, (dim, key, order) in enumerate(dimensions):
        place = unused(out.columns, f"_o{i}")
        out = out.join(dim.select(key, F.col(order).alias(place)), key, "left")
        keys.append(F.col(place).asc_nulls_last())
    return out.orderBy(*keys, *then).select(*names)


def grid(parts: list[DataFrame]) -> DataFrame:
    """All combinations of small identity tables (datasets, methods, seeds), distinct first."""
    out = parts[0].distinct()
    for p in parts[1:]:
        out = out.crossJoin(p.distinct())
    return out


def grid_audit(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and unexpected identities, and repeated ones: keys, problem."""
    own = df.select(*keys)
    tell = lambda d, p: d.select(*keys, F.lit(p).alias("problem"))
    missing = tell(expected.select(*keys).join(own, keys, "left_anti"), "missing")
    extra = tell(own.distinct().join(expected, keys, "left_anti"), "unexpected")
    twice = tell(own.groupBy(*keys).count().where("count > 1"), "repeated")
    return missing.unionByName(extra).unionByName(twice)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one side has: columns and side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def back_filter(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose identity ``old`` has, against ``old``: what was not preserved."""
    return difference(new.select(*old.columns).join(old.select(*keys), keys, "left_semi"), old)


def without(df: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(pairs, keys, "left_anti")


def full_outer_audit(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: added, removed, changed or same. A null value is a value like others; null keys meet no key."""
    a, b = unused([key], "a"), unused([key], "b")
    l, r = left.select(key, F.struct(F.col(value).alias("v")).alias(a)), right.select(key, F.struct(F.col(value).alias("v")).alias(b))
    s = F.when(F.col(a).isNull(), "added").when(F.col(b).isNull(), "removed").when(F.col(a)["v"].eqNullSafe(F.col(b)["v"]), "same").otherwise("changed")
    return l.join(r, key, "full_outer").select(key, s.alias("status"))


def pivot(df: DataFrame, index: list[str], column: str, values: list, measures: list[str]) -> DataFrame:
    """One column per category (and measure, named measure__category); cells must be unique."""
    require_unique(df, [*index, column], "cell")
    p = df.groupBy(*index).pivot(column, values).agg(*(F.first(m).alias(m) for m in measures))
    return p if len(measures) == 1 else p.select(*index, *(F.col(f"`{v}_{m}`").alias(f"{m}__{v}") for m in measures for v in map(str, values)))


def first_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    k = unused(df.columns, "_k")
    return df.withColumn(k, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(k) == 1).drop(k)


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def joined_names(df: DataFrame, keys: list[str], order: str, name: str, separator: str = ";") -> DataFrame:
    """Names of a group in a given order, as one text."""
    v = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, name))), lambda x: x[name]), separator)
    return df.groupBy(*keys).agg(v.alias(name))


def with_total(df: DataFrame, key: str, measures: list[str], label: str = "TOTAL") -> DataFrame:
    """Sums per key and a total row."""
    return df.rollup(key).agg(*(F.sum(m).alias(m) for m in measures)).select(F.coalesce(key, F.lit(label)).alias(key), *measures)
