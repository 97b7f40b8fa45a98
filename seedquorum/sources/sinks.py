"""Sinks: CSV in several number formats, JSON summaries, unions that keep old rows' text. Publication is in journal.py."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from seedquorum.operators.relational import ValidationError

BOM = "﻿"


def formatted(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Floating columns as text with so many significant digits, as C's %g (ties by the exact binary value, -0 keeps its sign); NaN is NULL. The others unchanged.

    Java's %g rounds the shortest decimal text of a double, so the digits come from an Arrow UDF.
    """
    if digits is None:
        return df
    fmt = f"%.{digits}g"

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else fmt % v for v in x.to_numpy(dtype=float)], dtype=object)

    return df.select(*(text(F.col(f"`{f.name}`").cast("double")).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema))


def write_csv(df: DataFrame, path: str, digits: int | None = None, null: str = "", bom: bool = False, sep: str = ",") -> None:
    """Refuses to overwrite. A byte order mark goes before the first column's name. Quotes are doubled, an empty text is written as two quotes, blanks stay."""
    out = formatted(df, digits)
    if bom:
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    out.write.mode("errorifexists").csv(path, header=True, nullValue=null, sep=sep, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_summary(df: DataFrame, path: str) -> None:
    """One JSON document of a one-row table."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def token_union(old: DataFrame, new: DataFrame, keys: list[str], digits: int = 17) -> DataFrame:
    """Old rows as the exact text they had, new ones formatted; an identity in both is an error."""
    fresh = formatted(new, digits).select(*(F.col(c).cast("string").alias(c) for c in old.columns))
    if clash := old.join(fresh, keys, "left_semi").select(*keys).limit(1).collect():
        raise ValidationError(f"already there: {tuple(clash[0])}")
    return old.unionByName(fresh)
