"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. sketch   one pass over the texts: set size, a 128-bit digest of the shingle set, 128 minima of 32 bits.
2. collapse documents of equal sets to one point, so copies never meet each other again.
3. forest   24 signature orders of up to twelve minima. The points of an order are sorted by their minima (by range, with the
            point's number last, so a hot stretch spreads over tasks); the common prefix with the neighbours before is computed, and
            neighbours that share four minima or more are candidates: in a dense region they share a long prefix, in a
            sparse one a short one. P(no order with four in common | similarity 0.8) = (1 - 0.8**4)**24 = 3e-6.
4. confirm  of each point the candidate of longest prefix, the most alike and the smallest, by full sets; components of these links.
5. the rest regions (points with four minima in common) that still hold several components. One of at most ``BLOCK`` points is a
            leaf. The points of larger ones are dealt anew, deeper: 160 orders of eight minima (a pair of similarity 0.8 shares none with
            probability 5e-6), whose regions are leaves again. So a point stands in at most 24 + 160 leaves however large its region was.
            A leaf finds its candidates across components by sketch (estimates under 0.62 lie five deviations below 0.8) and returns a
            spanning forest; the forests' components are loose clusters. All candidates in a cluster (in pairs of blocks while these copy
            a point at most ``TREES`` times, else in its leaves) are confirmed by full sets until their components meet. No cap and
            no neighbour limit loses a link of a shared region, no list of a group's pairs is made, and a group of near copies, once
            joined, costs nothing more. Only the sketches of a region of eight common minima that still holds over ``BLOCK`` points of
            several components are copied more often, once per block of it.

Defined cases: null, empty and blank texts have an empty set and link with nothing; fewer words than a shingle are one
shingle; repeated rows are copies; rows of one doc_id with different texts are points of their own, each with its row in the
result; texts of any length are sketched and confirmed whole; of equal ids and texts one is as good as the other; a null doc_id is never a class's id unless all its rows are null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.llm import text as T
from seedquorum.operators.graph import connected_components
from seedquorum.plans.workspace import Workspace

TREES, DEPTH, WIDTH, TAIL = 24, 4, 128, 8
DEEPER, DEEP = 160, 8
FLOOR = 0.62
BLOCK = 1024
NEIGHBOURS = 2
_NO_ID = -(1 << 63)
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64)
#: The minima of each order of the forest, and of the deeper ones.
_ORDERS = [(np.arange(t * DEPTH, t * DEPTH + DEPTH + TAIL) % WIDTH) for t in range(TREES)]
_DEEP_ORDERS = [_rng.permutation(WIDTH)[:DEEP] for _ in range(DEEPER)]


def shingle_sets(column: pa.Array, k: int):
    """Per row the sorted distinct 64-bit hashes of its k-word shingles."""
    data, offs = T.flat(column)
    for i, j in T.blocks(offs):
        part, b = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, _, _, at = T.words(part, b)
        # a running combination of k word hashes; rows with fewer words take what they have
        roll = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for d in range(k):
            roll = roll * np.uint64(0xD6E8FEB86659FD93) + h[d : len(h) - k + 1 + d] if len(roll) else roll
        roll = T.mix(roll)
        for r in range(j - i):
            lo, hi = at[r], at[r + 1]
            if hi - lo >= k:
                yield np.unique(roll[lo : hi - k + 1])
            elif hi > lo:
                x = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for w in h[lo:hi]:
                        x = x * np.uint64(0xA0761D6478BD642F) + w
                yield T.mix(np.array([x], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                hi.append(int(np.bitwise_xor.reduce(T.mix(s + np.uint64(1)))) if len(s) else 0)
                lo.append(int(T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc", "th")), pa.array(n, pa.int64()), as_long(hi), as_long(lo), pa.array(sig, pa.binary())], ["doc_id", "doc", "th", "n", "hi", "lo", "sig"])

    return T.released(run)


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, WIDTH)


def _regions(orders: list[np.ndarray], depth: int, seed: int):
    """A row per point and order: the key of the region that shares the order's first minima."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, ids = _signatures(batch), batch.column("point")
            for t, order in enumerate(orders):
                x = np.full(len(sig), seed + t, np.uint64)
                for d in order[:depth]:
                    x = T.mix(x * np.uint64(0x9E6C63D0876A9A47) + sig[:, d])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.full(len(sig), t, np.int32)), ids], ["region", "tree", "point"])

    return T.released(run)


def _small(sig: np.ndarray) -> pa.Array:
    """A byte of each minimum as sketch."""
    return pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())


@T.released
def _tails(batches):
    """The order's further minima, big-endian so that bytes sort."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _signatures(batch)
        cols = np.array([o[DEPTH:] for o in _ORDERS])[batch.column("tree").to_numpy()]
        tail = np.take_along_axis(sig, cols, 1).astype(">u4")
        yield pa.RecordBatch.from_arrays([batch.column("region"), pa.array([x.tobytes() for x in tail], pa.binary()), batch.column("point"), batch.column("n"), _small(sig)], ["region", "tail", "point", "n", "small"])


@T.released
def _sketches_of(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("n"), _small(_signatures(batch))], ["point", "n", "small"])


def _estimate(same: np.ndarray) -> np.ndarray:
    """Similarity from agreeing bytes: 1 in 256 agree by chance."""
    return (same / WIDTH - 1 / 256) / (1 - 1 / 256)


def _neighbours(percent: int):
    """Candidates in the sorted order: a point and those before it, with the minima that their prefixes have in common."""

    def pairs(batch):
        region, point, n = (batch.column(c).to_numpy() for c in ("region", "point", "n"))
        small = np.frombuffer(b"".join(batch.column("small").to_pylist()), np.uint8).reshape(-1, WIDTH)
        tail = np.frombuffer(b"".join(batch.column("tail").to_pylist()), ">u4").reshape(-1, TAIL)
        for d in range(1, NEIGHBOURS + 1):
            shared = DEPTH + np.logical_and.accumulate(tail[d:] == tail[:-d], axis=1).sum(1)
            est = _estimate((small[d:] == small[:-d]).sum(1))
            ok = (region[d:] == region[:-d]) & (est >= FLOOR) & (100 * np.minimum(n[d:], n[:-d]) >= percent * np.maximum(n[d:], n[:-d])) & (point[d:] != point[:-d])
            a, b = point[d:][ok], point[:-d][ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shared[ok].astype(np.int32)), pa.array(est[ok])], ["a", "b", "shared", "est"])

    def run(batches):
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if before is not None:
                batch = pa.concat_batches([before, batch])
            before = batch.slice(max(0, batch.num_rows - NEIGHBOURS))
            yield from pairs(batch)

    return T.released(run)


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _open_pairs(table: pa.Table, percent: int):
    """(i, js): positions in a leaf, or in a pair of blocks, that may be similar and lie in different components."""
    n, comp, side = (table.column(c).to_numpy() for c in ("n", "comp", "side"))
    small = np.frombuffer(b"".join(table.column("small").to_pylist()), np.uint8).reshape(-1, WIDTH)
    for i in range(len(n)):
        js = np.arange(i + 1, len(n))
        js = js[side[js] != side[i]] if side.any() else js
        js = js[(comp[js] != comp[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
        if len(js):
            js = js[_estimate((small[js] == small[i]).sum(1)) >= FLOOR]
            if len(js):
                yield i, js.tolist()


def _loose(percent: int):
    """A spanning forest of the candidates in a leaf."""

    def run(table: pa.Table) -> pa.Table:
        point, forest, out = table.column("point").to_numpy(), _Forest(table.num_rows), []
        for i, js in _open_pairs(table, percent):
            out += [(point[i], point[j]) for j in js if forest.join(i, j)]
        a, b = zip(*out, strict=True) if out else ((), ())
        leaf = table.column("leaf")[0].as_py()
        return pa.table({"leaf": pa.array([leaf] * len(out), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _loose_leaves(percent: int):
    """``_loose`` of every leaf of several components; rows come sorted by leaf, many small leaves in a batch."""
    one = _loose(percent)

    def work(rows: pa.Table):
        region, comp = rows.column("region").to_numpy(), rows.column("comp").to_numpy()
        first = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(first, len(region)))
        open_ = (np.minimum.reduceat(comp, first) < np.maximum.reduceat(comp, first)) & (size <= BLOCK)
        for k in np.flatnonzero(open_):
            yield from one(rows.slice(int(first[k]), int(size[k]))).to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= 20_000:
                rows = pa.Table.from_batches(held)
                region = rows.column("region").to_numpy()
                cut = int(np.searchsorted(region, region[-1]))  # the last leaf may go on
                if cut:
                    yield from work(rows.slice(0, cut))
                held, n = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held:
            yield from work(pa.Table.from_batches(held))

    return T.released(run)


def _settle(k: int, percent: int):
    """Confirms a group's candidates by full sets until their components meet; returns the links that joined some."""

    def run(table: pa.Table) -> pa.Table:
        point, comp = table.column("point").to_numpy(), table.column("comp").to_numpy()
        sets = list(shingle_sets(table.column("text").combine_chunks(), k))
        forest, first, out = _Forest(table.num_rows), {}, []
        for i, c in enumerate(comp):
            forest.join(i, first.setdefault(c, i))
        for i, js in _open_pairs(table, percent):
            for j in js:
                if forest.find(i) != forest.find(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        forest.join(i, j)
                        out.append((point[i], point[j]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _in_blocks(rows: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Leaves of whole groups, or, of those over ``BLOCK``, of each pair of blocks: leaves of two sides. ``sizes``: group and rows c."""
    sizes = sizes.select(group, F.when(F.col("c") <= BLOCK, 1).otherwise(F.ceil(F.col("c") * 2 / BLOCK)).cast("int").alias("blocks"))
    rows = rows.join(sizes, group).withColumn("own", F.expr("cast(pmod(xxhash64(point), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.select(F.concat_ws(":", F.lit(group), group, low, high).alias("leaf"), "point", "n", "small", "comp", F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0).alias("side"))


def _confirm(k: int, percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        last_id, last = None, None
        for batch in batches:
            keep, ids = [], batch.column("a").to_pylist()
            left = None
            rights = shingle_sets(batch.column("text_b"), k)
            column = batch.column("text_a")
            for i, y in enumerate(rights):
                if ids[i] != last_id:
                    last_id, last = ids[i], next(shingle_sets(column.slice(i, 1), k))
                left = last
                both = len(np.intersect1d(left, y, assume_unique=True))
                keep.append(bool(len(left) and len(y)) and 100 * both >= percent * (len(left) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return T.released(run)


def _classes(docs: DataFrame, k: int, percent: int, work: Workspace) -> DataFrame:
    """(doc_id, doc, th, n, point, component): a row per row of ``docs``; doc is the id, the least long for null; point and component are null for empty sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    sketches = work.write(docs.mapInArrow(_sketch(k), "doc_id long, doc long, th long, n long, hi long, lo long, sig binary"), "sketches")
    own = sketches.where("n > 0").groupBy("hi", "lo", "n").agg(F.min(F.struct("doc", "th")).alias("r"), F.first("sig").alias("sig"))
    own = work.write(own.select("hi", "lo", "n", "r.*", "sig", F.monotonically_increasing_id().alias("point")), "own")
    rows = work.write(own.select("point", "sig").mapInArrow(_regions(_ORDERS, DEPTH, 1), "region long, tree int, point long"), "regions")
    shared = rows.groupBy("region").agg(F.count("*").alias("c")).where("c > 1").select("region")
    rows = rows.join(shared, "region", "left_semi").join(own.select("point", "n", "sig"), "point").select("region", "tree", "point", "n", "sig")
    rows = work.write(rows.mapInArrow(_tails, "region long, tail binary, point long, n long, small binary"), "rows")
    work.drop("regions")
    in_order = rows.repartitionByRange("region", "tail", "point").sortWithinPartitions("region", "tail", "point")
    near = in_order.mapInArrow(_neighbours(percent), "a long, b long, shared int, est double")
    near = work.write(near.groupBy("a", "b").agg(F.max("shared").alias("shared"), F.max("est").alias("est")), "near")

    def fetched(points: DataFrame, name: str) -> DataFrame:
        wanted = points.join(own.select("point", "doc", "th"), "point")
        return work.write(docs.join(wanted, ["doc", "th"]).dropDuplicates(["point"]).select("point", "text"), name)

    ends = near.select(F.col("a").alias("point")).union(near.select(F.col("b").alias("point"))).distinct()
    texts = fetched(work.write(ends, "ends"), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        left, right = texts.select(F.col("point").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("point").alias("b"), F.col("text").alias("text_b"))
        full = pairs.select("a", "b").join(right, "b").join(left, "a").sortWithinPartitions("a").select("a", "b", "text_a", "text_b")
        return work.write(full.mapInArrow(_confirm(k, percent), "a long, b long"), f"links_{name}")

    def classes(links: DataFrame, name: str) -> DataFrame:
        return work.write(connected_components(links, "a", "b").withColumnRenamed("id", "point"), name)

    # each point's neighbour of longest prefix, most alike and smallest: enough to join a group of near copies at once
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "est"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("shared", "est", F.col("b"))).alias("b1"), F.max_by("b", F.struct("est", -F.col("b"))).alias("b2"), F.min_by("b", F.struct(F.col("est") < percent / 100, "b")).alias("b3"))
    best = best.select("a", F.explode(F.array_distinct(F.array("b1", "b2", "b3"))).alias("b"))
    tried = work.write(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    links = confirmed(tried, "best")
    found = classes(links, "classes")

    # the rest: what shares a region but not yet a component
    def with_components(rows: DataFrame) -> DataFrame:
        return rows.join(found, "point", "left").select("region", "point", "n", "small", F.coalesce("component", "point").alias("comp"))

    def named(left: DataFrame, level: str) -> DataFrame:
        return left.select(F.concat_ws(":", F.lit(level), "region").alias("leaf"), "region", "point", "n", "small", "comp", F.lit(0).alias("side"))

    def large(left: DataFrame, name: str) -> DataFrame:
        sizes = left.groupBy("region").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("c") > BLOCK)
        return work.write(sizes, name)

    def forest(left: DataFrame, over: DataFrame) -> DataFrame:
        left = left if over.isEmpty() else left.join(over.select("region"), "region", "left_anti")
        return left.repartition("region").sortWithinPartitions("region").mapInArrow(_loose_leaves(percent), "leaf string, a long, b long")

    left = work.write(named(with_components(rows), "first"), "left")
    over = large(left, "large")
    loose, leaf = forest(left, over), left
    wide = over.where("lo < hi")
    if not wide.isEmpty():
        again = work.write(left.join(wide.select("region"), "region", "left_semi").select("point").distinct(), "again").join(own.select("point", "n", "sig"), "point")
        deep = work.write(again.mapInArrow(_regions(_DEEP_ORDERS, DEEP, 1 << 20), "region long, tree int, point long"), "deep")
        several = deep.groupBy("region").agg(F.count("*").alias("c")).where("c > 1").select("region")
        deep = deep.join(several, "region", "left_semi").join(again.select("point", "n", "sig").mapInArrow(_sketches_of, "point long, n long, small binary"), "point")
        deep = work.write(named(with_components(deep), "deep"), "deeper")
        over = large(deep, "large_deep")
        blocks = _in_blocks(deep.drop("leaf", "side"), "region", over.where("lo < hi"))
        loose = loose.unionByName(forest(deep, over)).unionByName(blocks.groupBy("leaf").applyInArrow(_loose(percent), "leaf string, a long, b long"))
        leaf = leaf.drop("region").unionByName(deep.drop("region")).unionByName(blocks)
    loose = work.write(loose, "loose")
    if not loose.isEmpty():
        # candidates of one loose cluster are confirmed together; those of a huge one leaf by leaf
        cluster = work.write(connected_components(loose.select("a", "b"), "a", "b").select(F.col("id").alias("point"), F.col("component").alias("cluster")), "clusters")
        # nearly all of them are ends of candidates already
        absent = work.write(cluster.select("point").join(texts.select("point"), "point", "left_anti"), "absent")
        if not absent.isEmpty():
            texts = texts.unionByName(fetched(absent, "texts_absent"))
        counts = work.write(cluster.groupBy("cluster").agg(F.count("*").alias("c")), "counts")
        one = cluster.join(leaf.select("point", "n", "small", "comp").dropDuplicates(["point"]), "point")
        fit = F.col("c") <= BLOCK * TREES // 2
        groups = _in_blocks(one, "cluster", counts.where(fit))
        huge = counts.where(~fit)
        if not huge.isEmpty():
            held = loose.select("leaf", F.col("a").alias("point")).unionByName(loose.select("leaf", F.col("b").alias("point"))).distinct()
            held = cluster.join(huge.select("cluster"), "cluster").select("point").join(held, "point")
            groups = groups.unionByName(held.join(leaf, ["leaf", "point"]).select(*groups.columns))
        groups = groups.join(texts, "point")
        more = work.write(groups.groupBy("leaf").applyInArrow(_settle(k, percent), "a long, b long").distinct(), "links_rest")
        if not more.isEmpty():
            found = classes(links.unionByName(more), "classes_all")
    of = work.write(own.join(found, "point", "left").select("hi", "lo", "n", "point", F.coalesce("component", "point").alias("component")), "of")
    out = sketches.select("doc_id", "doc", "th", "n", "hi", "lo").join(of, ["hi", "lo", "n"], "left").drop("hi", "lo")
    for name in ("own", "rows", "near", "tried", "left", "ends", "texts", "absent", "texts_absent", "loose", "clusters", "counts", "large", "large_deep", "again", "deep", "deeper"):
        work.drop(name)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of ``docs`` (doc_id, text) under similarity >= percent / 100."""
    work = work or Workspace(docs.sparkSession, "neardup")
    rows = work.write(_classes(docs, k, percent, work), "placed")
    least = work.write(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    out = rows.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of ``docs``, all columns: of its smallest doc_id (nulls last), then of the smallest hash of its text.

    Rows whose texts have no words are classes of their own. Rows of equal id (or both null) and text are one document, of which
    any one row stays; rows of one id with different texts are judged by their texts.
    """
    work = Workspace(docs.sparkSession, "one-of-each")
    rows = work.write(_classes(docs, k, percent, work), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc", "th")).alias("first")
    kept = rows.where("component is not null").groupBy("component").agg(first).select("first.doc", "first.th")
    kept = kept.unionByName(rows.where("component is null").select("doc", "th").distinct())
    d, h = (T.unused(docs.columns, n) for n in ("own_doc", "own_text"))
    keyed = docs.withColumns({d: F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)), h: F.xxhash64(docs["text"])})
    return keyed.join(kept.toDF(d, h), [d, h], "left_semi").dropDuplicates([d, h]).drop(d, h)


def op2_minhash_lsh_forest(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=4)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
