"""Exact duplicates by a content sort (DataFrame functions only).

Texts are compared without white space. Sampled splitters range-partition the normalised bytes (their opening bytes, then a hash
of the whole, so that common openings spread too and the driver's sample of splitters stays small), Spark's external sort places
equal texts next to each other, and a window compares neighbours by their full texts. Of equal texts the row with the most code
points before normalising stays, then the one of smallest id.

A group that would fill more than a fair partition is dealt to as many parts as it fills; each part finds its own best row, and
the parts' best rows, at most two for each partition, meet by full comparison. No group is ever whole in one task.

Defined cases: null counts as empty; empty and white texts equal each other; a null id comes after all others; of rows equal in
id and length too one stays; an empty table gives an empty result; texts of any length are sorted and compared whole; columns
besides the key and the text may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.plans.workspace import Workspace

SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a normalised text that take part in the splitters.
HEAD = 24


def _rows(docs: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    """id, row (all columns of ``docs`` if ``whole``), norm, chars, hash; from numbered columns."""
    names = T.numbered(docs.columns)
    d, at = docs.toDF(*names), docs.columns.index
    t = F.coalesce(F.col(names[at(text)]), F.lit(""))
    row = [F.struct(*names).alias("row")] if whole else []
    d = d.select(F.col(names[at(key)]).alias("id"), *row, F.translate(t, SPACES, "").alias("norm"), F.length(t).alias("chars"))
    return d.withColumn("hash", F.xxhash64("norm"))


def _parts(rows: DataFrame, work: Workspace) -> DataFrame:
    """hash, parts: texts whose copies hold more bytes than a fair partition. Fewer rows than there are partitions, so safe to broadcast."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("hash").agg(F.sum(F.octet_length("norm") + F.lit(64)).alias("bytes"), F.count("*").alias("c"))
    sizes = work.write(sizes, "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    fair = max(1, total // n)
    return work.write(sizes.where((F.col("bytes") > fair) & (F.col("c") > 1)).select("hash", F.ceil(F.col("bytes") / fair).cast("int").alias("parts")), "parts")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """A row per row of ``docs``: id, keep_id, group_size, kept, text_sha256; with ``whole`` also ``row``, all columns under numbered names."""
    work = Workspace(docs.sparkSession, "exact")
    rows = _rows(docs, key, text, whole)
    rows = rows.join(F.broadcast(_parts(rows, work)), "hash", "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))).withColumn("head", F.substring(F.col("norm").cast("binary"), 1, HEAD))
    order = Window.partitionBy("head", "hash", "part", "norm").orderBy(F.col("chars").desc(), F.col("id").asc_nulls_last())
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.repartitionByRange("head", "hash", "part").select(
        "id", *(["row"] if whole else []), "norm", "part", "parts", F.row_number().over(order).alias("n"), F.first("id").over(group).alias("keep"), F.first("chars").over(group).alias("chars"), F.count("*").over(group).alias("size")
    )
    best = F.when((F.col("n") == 1) & F.col("parts").isNotNull(), F.col("norm"))
    placed = work.write(placed.select("id", *(["row"] if whole else []), "keep", "size", "chars", "n", "part", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), best.alias("best")), "placed")
    met = Window.partitionBy("best").orderBy(F.col("chars").desc(), F.col("keep").asc_nulls_last(), "part")
    all_met = met.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met_parts = placed.where("best IS NOT NULL").select("sha", "part", F.first("keep").over(all_met).alias("keep_all"), F.sum("size").over(all_met).alias("size_all"), (F.row_number().over(met) == 1).alias("first"))
    out = placed.join(F.broadcast(met_parts), ["sha", "part"], "left")
    split = F.col("first").isNotNull()
    return out.select(
        "id",
        *(["row"] if whole else []),
        F.when(split, F.col("keep_all")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(split, F.col("size_all")).otherwise(F.col("size")).alias("group_size"),
        ((F.col("n") == 1) & F.coalesce("first", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def one_of_each_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of any names."""
    return exact_groups(docs, key, text, whole=True).where("kept").select("row.*").toDF(*docs.columns)


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


OP13_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM n WINDOW w AS (PARTITION BY x ORDER BY c DESC, doc_id NULLS LAST)
"""
