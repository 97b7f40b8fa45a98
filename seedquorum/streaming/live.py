"""Runs that arrive over time: contingency counts are additive, so a stream keeps them and each trigger scores what has come.

State is one row per (run, reference label, cluster), whatever the number of observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seedquorum.operators.agreement import UNIT, agreement


def contingency_stream(runs: DataFrame) -> DataFrame:
    """Streaming contingency cells of runs against their reference labels."""
    keys = [*UNIT, "seed"]
    return runs.where("ref IS NOT NULL").groupBy(*keys, F.col("ref").alias("a"), F.col("cluster").alias("b")).agg(F.count("*").alias("n"))


def score_stream(runs: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Seed accuracy of all rows so far, written to ``target``/batch=<id> at each trigger; a repeated batch overwrites itself."""

    def score(cells: DataFrame, batch: int) -> None:
        agreement(cells, [*UNIT, "seed"]).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    q = contingency_stream(runs).writeStream.outputMode("complete").foreachBatch(score).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
