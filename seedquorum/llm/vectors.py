"""Embedding near-duplicates by an epsilon grid order join.

1. collapse  bit-equal vectors to one point with a count, so a group of copies is one point with a weight.
2. order     vectors of length one are projected on the leading principal directions (from a distributed covariance); the
             grid cells of side epsilon on the first few of these, then the id, give a sequence, sorted by range.
3. join      the sequence is cut into blocks. Blocks meet by an equi-join on the first grid coordinate and its neighbour, and
             only if their boxes on the principal directions are within epsilon. Within a pair of blocks, intervals of the
             sequence are halved recursively, and those whose boxes are provably further apart are skipped; small
             intervals are compared by matrix products (single precision with a margin, then double).
4. count     each block pair returns per vector a weighted link count and the class that it found, never the pairs.

Cosine >= c of unit vectors is distance <= sqrt(2 - 2c) = epsilon, and a projection never lengthens a distance, so nothing
is lost. Defined cases: null, zero and ragged vectors and those with null or non-finite parts link with nothing; vectors of
different lengths don't link; parts of any size do, as far as doubles go; repeated rows are copies of each other; null ids are
vectors of their own that a class is named after only if it has no other; an empty table gives an empty result; vectors may have any length, and of a class the smallest id names it; further columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.operators.graph import connected_components
from seedquorum.plans.workspace import Workspace

BLOCK, LEAF = 4096, 256
GRID, AXES = 4, 16
PARTNERS = 32
_SLACK = 1e-5


@T.released
def _clean(batches):
    """Valid vectors as bytes of doubles with a digest; others with dim 0. A power of two brings the largest part near one, so no norm overflows."""
    for batch in batches:
        lists = batch.column("embedding")
        offs, part = lists.offsets.to_numpy().astype(np.int64), lists.values.cast(pa.float64())
        x = np.array(part.to_numpy(zero_copy_only=False), np.float64)  # null parts become NaN
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
        full = np.flatnonzero(size > 0)
        dim = np.zeros(len(lists), np.int32)
        if len(full):
            at = np.repeat(offs[full] - np.append(0, np.cumsum(size[full])[:-1]), size[full]) + np.arange(int(size[full].sum()))
            x, first = x[at], np.cumsum(size[full]) - size[full]
            top = np.maximum.reduceat(np.where(np.isfinite(x), np.abs(x), np.inf), first)
            good = np.isfinite(top) & (top > 0)
            keep = np.repeat(good, size[full])
            x = np.ldexp(x[keep], np.repeat(-np.frexp(top[good])[1], size[full][good])) + 0.0
            dim[full[good]] = size[full][good]
        else:
            x = x[:0]
        cut = np.append(0, np.cumsum(dim.astype(np.int64))) * 8
        raw = memoryview(np.ascontiguousarray(x)).cast("B")
        d = [xxhash.xxh3_128_intdigest(raw[s:e]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(cut), pa.py_buffer(raw)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(dim, pa.int32()), as_long([v >> 64 for v in d]), as_long([v & (1 << 64) - 1 for v in d]), body], ["vec_id", "dim", "hi", "lo", "x"])


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _moments(dim: int):
    """Sums of products per task; index ``dim`` stands for the constant one."""

    def run(batches):
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if batch.num_rows:
                u = np.hstack([_unit(batch.column("x"), dim), np.ones((batch.num_rows, 1))])
                total += u.T @ u
        i, j = np.triu_indices(dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    return T.released(run)


def _principal(points: DataFrame, dim: int) -> np.ndarray:
    m = np.zeros((dim + 1, dim + 1))
    for r in points.select("x").mapInArrow(_moments(dim), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (dim + 1)**2 / 2 rows
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    mean = m[:dim, dim] / max(m[dim, dim], 1)
    cov = m[:dim, :dim] / max(m[dim, dim], 1) - np.outer(mean, mean)
    return np.ascontiguousarray(np.linalg.eigh(cov)[1][:, ::-1][:, :AXES])


def _cells(axes: np.ndarray, dim: int, eps: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = np.floor(_unit(batch.column("x"), dim) @ axes[:, :GRID] / eps).astype(np.int32)
                c = np.hstack([c, np.zeros((len(c), GRID - c.shape[1]), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(c[:, k]) for k in range(GRID)] + [batch.column(n) for n in ("rep", "n", "x")], [*(f"c{k}" for k in range(GRID)), "rep", "n", "x"])

    return T.released(run)


def _blocks(axes: np.ndarray, dim: int, block: int):
    """The sorted sequence in blocks, with their boxes on the principal directions."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table):
            x = b"".join(t.column("x").to_pylist())
            y = _unit(t.column("x").combine_chunks(), dim) @ axes
            c, rep = t.column("c0").to_numpy(), t.column("rep").to_numpy()
            cols = [(int(rep[0]), pa.int64()), (int(c.min()), pa.int32()), (int(c.max()), pa.int32()), (y.min(0), pa.list_(pa.float64())), (y.max(0), pa.list_(pa.float64())), (rep.tobytes(), pa.binary()), (t.column("n").to_numpy().tobytes(), pa.binary()), (x, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in cols], ["block", "first", "last", "low", "high", "reps", "ns", "xs"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, block))
                held, n = t.slice(block).to_batches(), n - block
        if n:
            yield out(pa.Table.from_batches(held))

    return T.released(run)


class _Join:
    """Links within one pair of blocks."""

    def __init__(self, a, b, axes: np.ndarray, cosine: float, same: bool, leaf: int = LEAF):
        self.a, self.b, self.same, self.cosine, self.eps2 = a, b, same, cosine, 2 - 2 * cosine + _SLACK
        self.small = [x.astype(np.float32) for x in (a, b)]
        self.y = [x @ axes for x in (a, b)]
        self.root = np.arange(len(a) + len(b))
        self.boxes: dict = {}
        self.least = leaf

    def box(self, side: int, lo: int, hi: int):
        if (side, lo, hi) not in self.boxes:
            y = self.y[side][lo:hi]
            self.boxes[side, lo, hi] = y.min(0), y.max(0)
        return self.boxes[side, lo, hi]

    def apart(self, a0: int, a1: int, b0: int, b1: int) -> bool:
        (al, ah), (bl, bh) = self.box(0, a0, a1), self.box(1, b0, b1)
        gap = np.maximum(0, np.maximum(al - bh, bl - ah))
        return float(gap @ gap) > self.eps2

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)

    def leaf(self, a0: int, a1: int, b0: int, b1: int, na: np.ndarray, nb: np.ndarray, links) -> None:
        near = self.small[0][a0:a1] @ self.small[1][b0:b1].T >= self.cosine - _SLACK
        if self.same and a0 == b0:
            np.fill_diagonal(near, False)
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return
        exact = self.a[a0 + rows] @ self.b[b0 + cols].T >= self.cosine
        exact &= near[np.ix_(rows, cols)]
        links[0][a0 + rows] += exact @ nb[b0 + cols]
        if not (self.same and a0 == b0):
            links[1][b0 + cols] += exact.T @ na[a0 + rows]
        # classes of the leaf: each row to its first column, then columns by their first row
        base = 0 if self.same else len(self.a)
        left = exact
        while left.any():
            first = left.argmax(1)
            for i in np.flatnonzero(left.any(1)):
                self.union(a0 + int(rows[i]), base + b0 + int(cols[first[i]]))
            ra = np.array([self.find(a0 + int(i)) for i in rows])
            rb = np.array([self.find(base + b0 + int(j)) for j in cols])
            left = left & (ra[:, None] != rb[None, :])

    def go(self, a0: int, a1: int, b0: int, b1: int, na, nb, links) -> None:
        if a1 <= a0 or b1 <= b0 or self.apart(a0, a1, b0, b1):
            return
        own = self.same and a0 == b0
        if a1 - a0 <= self.least and b1 - b0 <= self.least:
            self.leaf(a0, a1, b0, b1, na, nb, links)
        elif own:
            m = (a0 + a1) // 2
            self.go(a0, m, a0, m, na, nb, links)
            self.go(a0, m, m, a1, na, nb, links)
            self.go(m, a1, m, a1, na, nb, links)
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            self.go(a0, m, b0, b1, na, nb, links)
            self.go(m, a1, b0, b1, na, nb, links)
        else:
            m = (b0 + b1) // 2
            self.go(a0, a1, b0, m, na, nb, links)
            self.go(a0, a1, m, b1, na, nb, links)


def _join(axes: np.ndarray, dim: int, cosine: float, leaf: int):
    """Rows by (a, salt): first block a itself, then its partners one by one."""

    def links(a, b, same: bool) -> pa.RecordBatch:
        (ia, na, x), (ib, nb, y) = a, b
        j = _Join(x, y, axes, cosine, same, leaf)
        la = np.zeros(len(ia), np.int64)
        found = (la, la if same else np.zeros(len(ib), np.int64))
        j.go(0, len(ia), 0, len(ib), na, nb, found)
        ids, count = (ia, la) if same else (np.concatenate([ia, ib]), np.concatenate(found))
        hit = np.flatnonzero(count)
        root = ids[[j.find(int(i)) for i in hit]] if len(hit) else ids[:0]
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(root)], ["rep", "links", "root"])

    def run(batches):
        own = None
        for batch in batches:
            salts, partner = batch.column("salt").to_pylist(), batch.column("partner").to_pylist()
            for r in range(batch.num_rows):
                reps, ns, xs = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("reps", np.int64), ("ns", np.int64), ("xs", np.float64)))
                x = xs.reshape(-1, dim)
                block = reps.copy(), ns.copy(), x / np.sqrt((x * x).sum(1))[:, None]
                if partner[r]:
                    yield links(own, block, False)
                else:
                    own = block
                    if not salts[r]:
                        yield links(own, own, True)

    return T.released(run)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, work: Workspace | None = None, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id) of ``vectors`` (vec_id, embedding). Sequences are cut into blocks, and block pairs halved down to leaves."""
    spark = vectors.sparkSession
    work = work or Workspace(spark, "vectors")
    eps = float(np.sqrt(2 - 2 * cosine))
    clean = work.write(vectors.select("vec_id", "embedding").mapInArrow(_clean, "vec_id long, dim int, hi long, lo long, x binary"), "clean")
    points = clean.where("dim > 0").groupBy("dim", "hi", "lo").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("x").alias("x"))
    points = work.write(points.withColumn("rep", F.monotonically_increasing_id()), "points")
    found = None
    for dim in sorted(r["dim"] for r in points.select("dim").distinct().collect()):  # lengths of vectors: one, as a rule
        own = points.where(F.col("dim") == dim).select("rep", "n", "x")
        axes = _principal(own, dim)
        cells = [f"c{k}" for k in range(GRID)]
        grid = work.write(own.mapInArrow(_cells(axes, dim, eps), ", ".join(f"{c} int" for c in cells) + ", rep long, n long, x binary"), "grid")
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), grid.count() // block))
        order = grid.repartitionByRange(parts, *cells, "rep").sortWithinPartitions(*cells, "rep")
        blocks = work.write(order.mapInArrow(_blocks(axes, dim, block), "block long, first int, last int, low array<double>, high array<double>, reps binary, ns binary, xs binary"), "blocks")
        # the sequence is sorted by the first coordinate, so a block meets those that hold its cells or the next
        box = blocks.select("block", "first", "last", "low", "high")
        left = box.select(F.col("block").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), F.explode(F.expr("sequence(first - 1, last + 1)")).alias("cell"))
        right = box.select(F.col("block").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.explode(F.expr("sequence(first, last)")).alias("cell"))
        gap = "aggregate(transform(arrays_zip(al, ah, bl, bh), z -> greatest(0D, z.al - z.bh, z.bl - z.ah)), 0D, (s, g) -> s + g * g)"
        pairs = left.join(right, "cell").where("a <= b").where(f"{gap} <= {eps * eps + _SLACK}").select("a", "b").distinct()
        pairs = pairs.unionByName(left.join(right, "cell").where("a > b").where(f"{gap} <= {eps * eps + _SLACK}").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        # a block is shipped once for each of its partners, and itself once per PARTNERS of them
        pairs = work.write(pairs.where("a <> b"), "pairs")
        salts = pairs.groupBy("a").agg(F.expr(f"cast(count(*) div {PARTNERS} + 1 as int)").alias("salts"))
        salts = work.write(blocks.select(F.col("block").alias("a")).join(salts, "a", "left").select("a", F.coalesce("salts", F.lit(1)).alias("salts")), "salts")
        body = ["reps", "ns", "xs"]
        owners = salts.select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt")).join(blocks.select(F.col("block").alias("a"), *body), "a").select("a", "salt", F.lit(False).alias("partner"), *body)
        partners = pairs.join(salts, "a").select("a", F.expr("cast(pmod(xxhash64(b), salts) as int)").alias("salt"), "b").join(blocks.select(F.col("block").alias("b"), *body), "b").select("a", "salt", F.lit(True).alias("partner"), *body)
        full = owners.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "partner")
        hits = work.write(full.mapInArrow(_join(axes, dim, cosine, leaf), "rep long, links long, root long"), f"hits{dim}")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return clean.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = connected_components(found, "rep", "root").withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = points.drop("x").join(links, "rep", "left").join(classes, "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    of = work.write(of.select("dim", "hi", "lo", "class", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "of")
    least = work.write(of.groupBy("class").agg(F.min("least").alias("component_id")), "least")
    of = work.write(of.drop("least").join(least, "class").drop("class"), "classes")
    out = clean.select("vec_id", "dim", "hi", "lo").join(of, ["dim", "hi", "lo"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
