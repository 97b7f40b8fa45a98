"""File sources. Schemas are declared, never inferred: ids that look like numbers stay text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seedquorum.operators.relational import ValidationError, require_unique

BOM = "﻿"


def _named(df: DataFrame) -> DataFrame:
    """Without a byte order mark on the first column's name."""
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip(BOM).strip('"')) if df.columns and df.columns[0].startswith(BOM) else df


#: Stand in for a quoted empty cell and for a null that no cell holds, so that the one is told from the other.
_EMPTY, _NEVER = "\ue000\ue001", "\ue000\ue002"


def _cells(spark: SparkSession, path: str, header: bool, sep: str, null: str, multi_line: bool) -> DataFrame:
    """Every cell as text: unquoted empty cells (or ``null``) are NULL, quoted empty ones the empty text, blanks stay."""
    got = spark.read.csv(path, header=header, inferSchema=False, sep=sep, nullValue=null or _NEVER, emptyValue=_EMPTY, multiLine=multi_line, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return got.select(*(F.when(F.col(f"`{c}`") == _EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) for c in got.columns))


def read_csv(spark: SparkSession, path: str, schema: str | StructType, header: bool = True, sep: str = ",", null: str = "", multi_line: bool = False) -> DataFrame:
    """CSV or TSV with declared columns; with a header, columns are found by name (other ones ignored, a missing one is an error), else by place.

    Cells with line ends need ``multi_line``, with which a file is read in one task.
    """
    text = _cells(spark, path, header, sep, null, multi_line)
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if header:
        text = _named(text)
        if missing := [f.name for f in want if f.name not in text.columns]:
            raise ValidationError(f"{path} has no {missing}")
    else:
        text = text.toDF(*want.names)
    return text.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want))


def read_tsv(spark: SparkSession, path: str, schema: str | StructType, header: bool = True, null: str = "") -> DataFrame:
    return read_csv(spark, path, schema, header, "\t", null)


def read_tokens(spark: SparkSession, path: str, keys: list[str], sep: str = ",") -> DataFrame:
    """Every cell as its exact text; repeated keys are an error."""
    return require_unique(_named(spark.read.csv(path, header=True, inferSchema=False, sep=sep, quote='"', escape='"', emptyValue="", nullValue="\x00")), keys)


def read_json_documents(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One document per file, with its path."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def discover(spark: SparkSession, path: str, name: str, expected: int | None = None) -> DataFrame:
    """path, length, modified of files of one name anywhere below; an exact count may be demanded."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    if expected is not None and (n := found.count()) != expected:
        raise ValidationError(f"{n} files {name} under {path}, not {expected}")
    return found


def single_match(spark: SparkSession, pattern: str) -> str:
    """The one path that a glob matches, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p) or []
    if len(found) != 1:
        raise ValidationError(f"{len(found)} matches for {pattern}")
    return found[0].getPath().toString()


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """row, column (from 1), value of a coordinate matrix; a symmetric one lists both halves; pattern entries are 1.

    The size line is the first line that is neither a comment nor blank; it is told from entries by its place in the file.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")).alias("at"))
    full = ~F.col("value").startswith("%") & (F.trim("value") != "")
    head = lines.agg(F.min_by("value", "at").alias("banner"), F.min(F.when(full, F.col("at"))).alias("size")).first()
    if not (head["banner"] or "").lower().startswith("%%matrixmarket matrix coordinate"):
        raise ValidationError(f"{path} is no coordinate matrix")
    if head["size"] is None:
        raise ValidationError(f"{path} has no size line")
    banner = head["banner"].lower().split()
    rows = lines.where(full & (F.col("at") > F.struct(F.lit(head["size"]["block"]).alias("block"), F.lit(head["size"]["i"]).alias("i"))))
    s = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if "pattern" in banner else s[2].cast("double")
    out = rows.select(s[0].cast("long").alias("row"), s[1].cast("long").alias("column"), value.alias("value"))
    if "symmetric" in banner:
        out = out.unionByName(out.where("row <> column").select(F.col("column").alias("row"), F.col("row").alias("column"), "value"))
    return out


def read_arrays(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, row, vector of the named two-dimensional array in .npz files (or the array of .npy files)."""

    def run(batches):
        import io

        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                got = np.load(io.BytesIO(raw), allow_pickle=False)
                a = np.atleast_2d(got[name] if hasattr(got, "files") else got).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(a)), pa.array(np.arange(len(a))), pa.array(list(a), pa.list_(pa.float64()))], ["path", "row", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, vector array<double>")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 (upper case) of every file below."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))


def folder_digests(spark: SparkSession, path: str, depth: int = 1, names: bool = True) -> DataFrame:
    """folder, n_files, bytes, sha256 of the folders ``depth`` below a path: the digest of their files' sorted (path within, digest) lines.

    Without ``names`` of the digests alone, as Spark's file names differ from run to run. Data pass through the tasks that hash them; a folder's
    lines, one per file, are sorted in a task.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toUri().getPath().rstrip("/")
    within = F.split(F.substring(F.regexp_replace("path", "^[a-zA-Z0-9]+:/*", "/"), len(root) + 2, 1 << 30), "/")
    f = file_hashes(spark, path).select(F.array_join(F.slice(within, 1, depth), "/").alias("folder"), F.array_join(F.slice(within, depth + 1, 1000), "/").alias("name"), "bytes", "sha256")
    line = F.concat_ws(" ", "name", "sha256") if names else F.col("sha256")
    out = f.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list(line)).alias("lines"))
    return out.select("folder", "n_files", "bytes", F.upper(F.sha2(F.array_join("lines", "\n").cast("binary"), 256)).alias("sha256"))


def compare_baseline(before: DataFrame, after: DataFrame, key: str = "folder") -> DataFrame:
    """key, status (added, removed, changed, same) of two tables of digests."""
    b, a = before.select(key, F.col("sha256").alias("was")), after.select(key, F.col("sha256").alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    return b.join(a, key, "full_outer").select(key, status.alias("status"))


def text_schema(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])
