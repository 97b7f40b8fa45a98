"""Column expressions. Doubles throughout: ``2D`` rather than ``2.0``, which Spark would read as a decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frozen study constants.
ISO_THRESHOLDS = (0.01, 0.02, 0.03)
PRIMARY_ISO = 0.02
DIVERGENT = 0.50
EPS = 1e-12
LOW_SD, HIGH_INSTABILITY = 0.02, 0.30
CALIPER = 0.002
HIGH_SUPPORT, LOW_SUPPORT = 0.8, 0.5
FREQUENT, RARE = 0.80, 0.20


def pairs_of(n: Column) -> Column:
    """n choose 2."""
    return n * (n - 1) / F.lit(2.0)


def iso_accuracy(a: Column, b: Column, threshold, epsilon: float = EPS) -> Column:
    """Equal scores: difference at most the threshold, the boundary included. ``epsilon=0`` is the raw comparison."""
    return F.abs(a - b) <= threshold + F.lit(epsilon)


def divergent(ari: Column) -> Column:
    return ari < DIVERGENT


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def close(a: Column, b, rtol: float = 0.0, atol: float = 1e-12) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def masked_divide(a: Column, b: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.try_divide(a, b)


def snap(x: Column, allowed: tuple[float, ...] = ISO_THRESHOLDS, tolerance: float = 1e-15) -> Column:
    """The prespecified value within tolerance, else an error."""
    hit = F.lit(None).cast("double")
    for v in allowed:
        hit = F.when(F.abs(x - v) <= tolerance, F.lit(v)).otherwise(hit)
    return F.when(x.isNull(), None).otherwise(F.coalesce(hit, F.raise_error(F.concat(F.lit("not a prespecified threshold: "), x.cast("string"))).cast("double")))


def parse_boolean(x: Column) -> Column:
    """Exactly true or false in any case, else an error; null stays null."""
    t = F.lower(F.trim(x))
    return F.when(t == "true", True).when(t == "false", False).when(x.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))


def parse_timestamp(x: Column) -> Column:
    """ISO 8601 with a zone; a text without a zone is an error."""
    zoned = x.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(x.isNull(), None).when(zoned, F.to_timestamp(x)).otherwise(F.raise_error(F.concat(F.lit("no time zone: "), x)).cast("timestamp"))


def number(x: Column, strict: bool = False) -> Column:
    """Double from text: NULL (or, strict, an error) where it isn't one; NaN and infinity become NULL."""
    v = x.cast("double") if strict else x.try_cast("double")
    return finite_or_null(v)


def canonical_name(x: Column) -> Column:
    """Display form: an ASCII hyphen before a digit is a minus sign."""
    return F.regexp_replace(x, r"-(?=\d)", "−")


def is_sha256(x: Column) -> Column:
    return x.rlike("^[0-9A-F]{64}$")


def digest(lines: Column) -> Column:
    """Upper-case SHA-256 of newline-joined strings in their given order."""
    return F.upper(F.sha2(F.array_join(lines, "\n").cast("binary"), 256))


def classify(x: Column, high: float, low: float, names: tuple[str, str, str] = ("high", "intermediate", "low")) -> Column:
    return F.when(x.isNull(), None).when(x >= high, names[0]).when(x <= low, names[2]).otherwise(names[1])


def correlation(x: str, y: str) -> Column:
    """Pearson; NULL with fewer than two pairs or a constant side."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    return F.expr(f"try_divide(covar_pop({a}, {b}), nullif(stddev_pop({a}) * stddev_pop({b}), 0D))")


def entropy_bits(p: str) -> Column:
    """Shannon entropy over positive probabilities."""
    return F.expr(f"-coalesce(sum(CASE WHEN {p} > 0 THEN {p} * log2({p}) END), 0D)")
