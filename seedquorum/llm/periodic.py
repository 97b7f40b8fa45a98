"""Periodic runs of words by bit-parallel lags.

A text's distinct words are numbered, and bit k of all its numbers is one big integer, a bit plane. For a lag q, each plane is
XORed with itself shifted by q, and the planes' differences are ORed: a zero says that the words q apart are equal. Repeated AND
of the equal places with themselves, shifted by doubling steps, leaves the starts of stretches that are long enough. A few
planes often settle a lag: if what they can't tell apart has no long stretch, the rest are not needed.

A run has its smallest period: a stretch at lag q over the very same words as a run found at a smaller lag is that run again.

Every text is worked on alone, in the task that reads it: nothing is shuffled. The lags of a text of n words cost about
n * n / 128 word operations a plane.

Defined cases: null and empty texts have no words and no run; repeated rows each give their own row; an empty table gives an empty result; a
text of any length is searched at every lag; of runs that start together all are given; columns of any names pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T

MIN_LENGTH = 12
#: Planes that are looked at before a first search for stretches.
FIRST_PLANES = 4
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def bit_planes(numbers: list[int], distinct: int) -> list[int]:
    """Plane k as an integer: its bit i is bit k of numbers[i]."""
    a = np.array(numbers, np.int64)
    rows = np.packbits((a >> np.arange(max(1, (distinct - 1).bit_length()))[:, None]) & 1 == 1, axis=1, bitorder="little")
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def long_stretches(ones: int, least: int) -> int:
    """The places from which ``least`` ones follow without a gap."""
    have = 1
    while ones and have < least:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def set_bits(x: int) -> list[int]:
    """Places of the ones, ascending."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")).tolist()


def find_runs(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal run of at least ``min_length`` words and two periods, by start and period."""
    n, ids = len(words), {}
    numbers = [ids.setdefault(w, len(ids)) for w in words]
    if n < min_length or len(ids) == n:
        return []
    planes, found = bit_planes(numbers, len(ids)), {}
    for q in range(1, n // 2 + 1):
        least, every, differ = max(min_length - q, q), (1 << (n - q)) - 1, 0
        for plane in planes[:FIRST_PLANES]:
            differ |= plane ^ (plane >> q)
        starts = long_stretches(~differ & every, least)
        if starts and len(planes) > FIRST_PLANES:
            for plane in planes[FIRST_PLANES:]:
                differ |= plane ^ (plane >> q)
            starts = long_stretches(~differ & every, least)
        if starts:
            for a, b in zip(set_bits(starts & ~(starts << 1)), set_bits(starts & ~(starts >> 1)), strict=True):
                found.setdefault((a, b + least + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that are in no run, or only among the first period's words of each run that holds them."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _search(text: str, min_length: int):
    @T.released
    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                every, kept = [], []
                for t in part.column(at):
                    words = (t.as_py() or "").encode().split()  # bytes split at the six white bytes of ASCII, no others
                    runs = find_runs(words, min_length)
                    every.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                    kept.append(b" ".join(collapse(words, runs) if runs else words).decode())
                own = [part.column(c) for c in range(part.num_columns) if c != at]
                names = [part.schema.names[c] for c in range(part.num_columns) if c != at]
                yield pa.RecordBatch.from_arrays([*own, pa.array(every, kind), pa.array(kept, pa.string())], names=[*names, "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with the text replaced by ``runs`` (start, length, period by word number) and ``collapsed``, the text without repetitions.

    Names that clash with the two get an underscore from them.
    """
    names = T.numbered(docs.columns)
    d, at = docs.toDF(*names), docs.columns.index(text)
    own = [(n, f.dataType.simpleString()) for i, (n, f) in enumerate(zip(names, docs.schema.fields, strict=True)) if i != at]
    out = d.mapInArrow(_search(names[at], min_length), ", ".join([*(f"{n} {kind}" for n, kind in own), f"runs {_RUNS}", "collapsed string"]))
    kept = [c for i, c in enumerate(docs.columns) if i != at]
    return out.toDF(*kept, T.unused(kept, "runs"), T.unused(kept, "collapsed"))


def longest_run(runs: Column) -> Column:
    """The longest run; of equally long ones the first, then the one of smaller period. Null if there is none."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period"))


def looped(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, chosen by the id's checksum, turn into loops of their own words from a place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(F.array(words), loop)[0]).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    rows = periodic_runs(docs).withColumn("best", longest_run(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
