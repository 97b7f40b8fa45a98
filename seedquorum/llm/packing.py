"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Lengths are at most the capacity, so the instance is a histogram of as many rows: counted by a distributed aggregate, solved on
the driver as numbers of equal sequences, and handed back as a table of (length, run of ranks) -> (sequences, offset). Neither the
histogram nor the plan grows with the number of documents.

Reduction: the longest length j left fixes a sequence when one small set dominates every other set that fits beside it:
j alone if nothing fits; j and k if k fills it exactly, or if no two pieces fit and k is the longest that fits; j with the pair (a, b) if no
three fit, a is the longest that fits, b the longest beside it, and no other pair has a longer second piece. It repeats until nothing
is fixed; best-fit decreasing packs the remainder.

Defined cases: null and empty texts are one piece of just the end id; only documents longer than the capacity are cut, and the
first piece is the shorter one; repeated and null doc_ids are packed each; an empty table gives no pieces; further columns aren't read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.llm import tokens
from seedquorum.plans.workspace import Workspace

CAPACITY = 2048


class _Stock:
    """Counts by length, with the lengths in stock kept sorted."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def longest(self, room: int, less: dict[int, int] | None = None) -> int | None:
        """The longest length that fits, when ``less`` of some are taken already."""
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and less and self.n[self.sizes[i]] <= less.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, k: int, less: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - less.get(s, 0))
            if len(out) >= k:
                break
        return out


def _dominating(stock: _Stock, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all others beside j, or None."""
    room, own = capacity - j, {j: 1}
    small = stock.smallest(3, own)
    if not small or small[0] > room:
        return ()
    k = stock.longest(room, own)
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return (k,)
    if len(small) > 2 and sum(small) <= room:
        return None
    taken = {j: 1}
    taken[k] = taken.get(k, 0) + 1
    b = stock.longest(room - k, taken)
    half = stock.longest(room // 2, own)
    if b is not None and (half is None or half <= b):
        return (k, b)
    if b is None and small[0] + small[1] > k:
        return None
    best = max((x + y for x in stock.sizes if x <= room for y in [stock.longest(room - x, {j: 1} | ({x: 2} if x == j else {x: 1}))] if y is not None), default=0)
    return (k,) if best <= k else None


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, tuple[int, ...]]], int]:
    """(number, lengths) of equal sequences, and how many sequences the reduction fixed."""
    stock, out = _Stock(counts), []
    again = True
    while again and stock.n:
        again = False
        for j in sorted(stock.n, reverse=True):
            while j in stock.n and (best := _dominating(stock, j, capacity)) is not None:
                bin_ = (j, *best)
                need: dict[int, int] = {}
                for s in bin_:
                    need[s] = need.get(s, 0) + 1
                # exact fills, and sets that no other set can beat while these lengths last, are fixed in bulk
                k = min(stock.n[s] // c for s, c in need.items())
                for s, c in need.items():
                    stock.take(s, c * k)
                out.append((k, bin_))
                again = True
    fixed = sum(k for k, _ in out)
    # best-fit decreasing over groups of equal open sequences, by room left
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []
    for j in sorted(stock.n, reverse=True):
        left = stock.n[j]
        while left:
            i = bisect.bisect_left(rooms, j)
            if i < len(rooms):
                room = rooms[i]
                group = open_[room][-1]
            else:
                room, group = capacity, [-(-left // (capacity // j)), ()]
            if i < len(rooms):
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            # each of the group's sequences takes as many as fit, one after another
            each = room // j
            full = min(group[0], left // each)
            parts = [(full, each)]
            rest = left - full * each
            if full < group[0] and 0 < rest < each:
                parts.append((1, rest))
            used = sum(n for n, _ in parts)
            left -= sum(n * e for n, e in parts)
            if used < group[0] and group[1]:
                parts.append((group[0] - used, 0))
            for n, e in parts:
                if n:
                    r = room - e * j
                    if r not in open_:
                        open_[r] = []
                        bisect.insort(rooms, r)
                    open_[r].append([n, (*group[1], *[j] * e)])
    out += [(n, lengths) for groups in open_.values() for n, lengths in groups]
    return out, fixed


def plan_rows(bins: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, count, first sequence, per sequence, offset) rows: a run of ranks of one length goes to consecutive sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, lengths in bins:
        at = 0
        for s in lengths:
            rows.append((s, used.get(s, 0), n, sequence, at))
            used[s] = used.get(s, 0) + n
            at += s
        sequence += n
    return rows


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    head = [(0, first)] if first else []
    return head + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        enc = tokens.encoder(path, end_id)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for i, j, ids, n in enc.slices(batch.column("text")):
                ids, at = ids.astype("<u4"), 0
                out = []
                for doc, k in zip(docs[i:j], n.tolist(), strict=True):
                    out += [(doc, p, s, length, zlib.crc32(ids[at + s : at + s + length])) for p, (s, length) in enumerate(cut(k, capacity))]
                    at += k
                cols = [*zip(*out, strict=True)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return T.released(run)


def pack(pieces: DataFrame, capacity: int = CAPACITY, work: Workspace | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    Ranks within a length are counted in salted groups (length, bucket), whose sizes are an aggregate, so the commonest length doesn't
    gather in one task.
    """
    spark = pieces.sparkSession
    work = work or Workspace(spark, "packing")
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, piece), {buckets}) as int)"))
    sizes = work.write(salted.groupBy("length", "bucket").agg(F.count("*").alias("n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    bins, _ = solve(counts, capacity)
    plan = spark.createDataFrame(plan_rows(bins), "length long, first long, n long, sequence long, offset long")
    before = sizes.selectExpr("length", "bucket", "sum(n) over (partition by length order by bucket) - n as before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, bucket order by doc_id, piece, start, ids_crc32) - 1 as own")
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    # a length's runs of ranks as one sorted array: its place is the last run that starts at or before the rank
    runs = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "sequence", "offset"))).alias("runs"))
    # at most ``capacity`` rows with the plan's few thousand runs in all, whatever the input
    out = ranked.join(F.broadcast(runs), "length")
    place = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    out = out.withColumn("place", place)
    return out.select(*pieces.columns, (F.col("place.sequence") + F.col("rank") - F.col("place.first")).alias("sequence_id"), F.col("place.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), packed."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path or tokens.default_path(), end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack(work.write(pieces, "pieces"), capacity, work)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
