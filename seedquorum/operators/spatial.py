"""Neighbours of points in the plane, by cells that halve where points are dense.

A cell with more than a few places is cut into four, and so on, so leaves are small everywhere. Degrees within a radius come from counts: a cell that
lies wholly within the circle counts as one number, one outside not at all, and only leaves that the circle cuts show their points. So
no pairs are listed, and a crowd costs its circle's edge, not its square. Components of the radius graph link a point with one point of each such cell.

Nearest neighbours start with the cells around a point at the size of its own leaf: it is done once its k-th distance is within the ring searched; the
rest go on with cells twice as wide, until none is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedquorum.operators.graph import connected_components
from seedquorum.operators.selection import quantiles
from seedquorum.plans.workspace import Workspace

#: Places of a leaf; bits of a cell's number, beyond which doubles don't tell places apart.
LEAF, BITS = 64, 52
#: Room for rounding when a cell is told to lie in or out of a circle.
ROUND = 1e-9


def _cells(points: DataFrame, side: float, reach: int, names: tuple[str, str, str]) -> DataFrame:
    """Each point once for every cell within ``reach`` of its own."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    o, x, y = names
    d = points.select("dataset", F.col("obs_id").alias(o), F.col("x").alias(x), F.col("y").alias(y), F.explode(around).alias("d"))
    return d.select("dataset", o, x, y, (F.floor(F.col(x) / side) + F.col("d.i")).alias("ci"), (F.floor(F.col(y) / side) + F.col("d.j")).alias("cj"))


def _distance() -> Column:
    return F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """dataset, src, dst, distance of ordered pairs within the radius (inclusive). The result grows with the square of a crowd: see ``degrees`` and ``radius_components``."""
    a = _cells(points, radius, 1, ("src", "x", "y"))
    b = _cells(points, radius, 0, ("dst", "x2", "y2"))
    return a.join(b, ["dataset", "ci", "cj"]).where("src <> dst").withColumn("distance", _distance()).where(F.col("distance") <= radius).select("dataset", "src", "dst", "distance")


def _floor(c: str, side: float) -> Column:
    return F.floor(F.col(c) / side)


def _halved(places: DataFrame, side: float, leaf: int, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """By level the cells (dataset, ci, cj, w, least, leaf) that have places; the places (dataset, x, y, ..) with the level of their leaf."""
    cells, leaves, active = [], None, places
    most = places.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    depth = max(0, BITS - max(0, math.ceil(math.log2(most / side + 1))))
    for level in range(depth + 1):
        s = side / 2**level
        at = active.withColumns({"ci": _floor("x", s), "cj": _floor("y", s)})
        c = at.groupBy("dataset", "ci", "cj").agg(F.sum("w").alias("w"), F.min("least").alias("least"), F.count("*").alias("m"))
        c = work.write(c.select("dataset", "ci", "cj", "w", "least", ((F.col("m") <= leaf) | F.lit(level == depth)).alias("leaf")), f"cells{level}")
        cells.append(c)
        both = at.join(c.select("dataset", "ci", "cj", "leaf"), ["dataset", "ci", "cj"]).drop("ci", "cj")
        own = both.where("leaf").drop("leaf").withColumn("level", F.lit(level))
        leaves = own if leaves is None else leaves.unionByName(own)
        if c.where("NOT leaf").isEmpty():
            break
        active = work.write(both.where("NOT leaf").drop("leaf"), f"active{level}")
    return cells, work.write(leaves, "leaves")


def _reach(points: DataFrame, radius: float, work: Workspace, leaf: int) -> tuple[DataFrame, DataFrame]:
    """The distinct places (dataset, x, y, w, least); and for each place (dataset, x, y, w, least) rows of what lies within the radius: the weight and
    smallest id of whole cells, and of single places in cells that the circle cuts. Cells lie in squares whose places are all within the radius of each other.
    """
    places = points.where("x IS NOT NULL AND y IS NOT NULL").select("dataset", (F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"), "obs_id")
    places = work.write(places.groupBy("dataset", "x", "y").agg(F.count("*").alias("w"), F.min("obs_id").alias("least")), "places")
    side = radius / 2**0.5 * (1 - ROUND)
    cells, leaves = _halved(places, side, leaf, work)
    near = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near))
    quarter = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    frontier = places.select("dataset", "x", "y", F.explode(around).alias("d")).select("dataset", "x", "y", (_floor("x", side) + F.col("d.i")).alias("ci"), (_floor("y", side) + F.col("d.j")).alias("cj"))
    found = None
    for level, c in enumerate(cells):
        s = side / 2**level
        gap = lambda x, i: F.greatest(F.lit(0.0), F.col(i) * s - F.col(x), F.col(x) - (F.col(i) + 1) * s)  # noqa: E731, B023
        far = lambda x, i: F.greatest(F.abs(F.col(x) - F.col(i) * s), F.abs((F.col(i) + 1) * s - F.col(x)))  # noqa: E731, B023
        norm = lambda f: F.sqrt(f("x", "ci") * f("x", "ci") + f("y", "cj") * f("y", "cj"))
        met = frontier.join(c, ["dataset", "ci", "cj"]).where(norm(gap) <= radius * (1 + ROUND)).withColumn("whole", norm(far) <= radius * (1 - ROUND))
        met = work.write(met, f"met{level}")
        here = leaves.where(F.col("level") == level).select("dataset", _floor("x", s).alias("ci"), _floor("y", s).alias("cj"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"), F.col("least").alias("least2"))
        cut = met.where("leaf AND NOT whole").select("dataset", "ci", "cj", "x", "y").join(here, ["dataset", "ci", "cj"]).where(_distance() <= radius).select("dataset", "x", "y", F.col("w2").alias("w"), F.col("least2").alias("least"))
        got = met.where("whole").select("dataset", "x", "y", "w", "least").unionByName(cut)
        found = got if found is None else found.unionByName(got)
        rest = met.where("NOT leaf AND NOT whole").select("dataset", "x", "y", "ci", "cj", F.explode(quarter).alias("d"))
        frontier = rest.select("dataset", "x", "y", (2 * F.col("ci") + F.col("d.i")).alias("ci"), (2 * F.col("cj") + F.col("d.j")).alias("cj"))
    return places, found


def degrees(points: DataFrame, radius: float, leaf: int = LEAF) -> DataFrame:
    """dataset, obs_id, degree: neighbours within the radius; isolated points, and those without a place, have zero."""
    work = Workspace(points.sparkSession, "degrees")
    _, found = _reach(points, radius, work, leaf)
    n = found.groupBy("dataset", "x", "y").agg((F.sum("w") - 1).alias("degree"))
    at = points.select("dataset", "obs_id", (F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"))
    return at.join(n, ["dataset", "x", "y"], "left").select("dataset", "obs_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def radius_components(points: DataFrame, radius: float, leaf: int = LEAF) -> DataFrame:
    """dataset, obs_id, component: the smallest id reachable by steps of at most the radius. Ids are unique over all datasets; points without a place are alone."""
    work = Workspace(points.sparkSession, "radius")
    places, found = _reach(points, radius, work, leaf)
    # the smallest of a cell's places stands for them, as they all lie within the radius of each other
    links = found.alias("f").join(places.alias("p"), ["dataset", "x", "y"]).select(F.col("p.least").alias("src"), F.col("f.least").alias("dst"))
    side = radius / 2**0.5 * (1 - ROUND)
    square = places.groupBy("dataset", _floor("x", side).alias("ci"), _floor("y", side).alias("cj")).agg(F.min("least").alias("first"))
    inner = places.withColumns({"ci": _floor("x", side), "cj": _floor("y", side)}).join(square, ["dataset", "ci", "cj"]).select(F.col("least").alias("src"), F.col("first").alias("dst"))
    c = connected_components(work.write(links.unionByName(inner).where("src <> dst"), "links"), "src", "dst")
    of = places.join(c.withColumnRenamed("id", "least"), "least", "left").select("dataset", "x", "y", F.coalesce("component", "least").alias("component"))
    at = points.select("dataset", "obs_id", (F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"))
    return at.join(of, ["dataset", "x", "y"], "left").select("dataset", "obs_id", F.coalesce("component", "obs_id").alias("component"))


def nearest(points: DataFrame, k: int, leaf: int = 16, work: Workspace | None = None) -> DataFrame:
    """dataset, src, dst, distance, rank of the k nearest others; ties by id."""
    work = work or Workspace(points.sparkSession, "nearest")
    points = points.where("x IS NOT NULL AND y IS NOT NULL").select("dataset", "obs_id", (F.col("x") + F.lit(0.0)).alias("x"), (F.col("y") + F.lit(0.0)).alias("y"))
    box = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*"), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
    if not box[2]:
        return points.selectExpr("dataset", "obs_id AS src", "obs_id AS dst", "x AS distance", "1 AS rank")
    wide = max(box[0], box[1], box[3] * 1e-12, 1e-300)
    places = work.write(points.groupBy("dataset", "x", "y").agg(F.count("*").alias("w"), F.min("obs_id").alias("least")), "places")
    _, own = _halved(places, wide, leaf, work)
    left = work.write(points.join(own.select("dataset", "x", "y", "level"), ["dataset", "x", "y"]).select("dataset", "obs_id", "x", "y", "level"), "left")
    # of points on one place only the k + 1 smallest ids can be among anyone's k nearest
    heap = F.row_number().over(Window.partitionBy("dataset", "x", "y").orderBy("obs_id"))
    points = work.write(points.withColumn("heap", heap).where(F.col("heap") <= k + 1).drop("heap"), "targets")
    out, level = None, left.agg(F.max("level")).first()[0]
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    while True:
        side = wide / 2.0**level
        whole = side > 2 * wide
        now = left.where(F.col("level") >= level)
        a = now.select("dataset", F.col("obs_id").alias("src"), "x", "y", F.explode(around).alias("d")).select("dataset", "src", "x", "y", (_floor("x", side) + F.col("d.i")).alias("ci"), (_floor("y", side) + F.col("d.j")).alias("cj"))
        b = points.select("dataset", F.col("obs_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), _floor("x", side).alias("ci"), _floor("y", side).alias("cj"))
        rows = a.join(b, ["dataset", "ci", "cj"]).where("src <> dst").withColumn("distance", _distance())
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("dataset", "src").orderBy("distance", "dst"))).where(F.col("rank") <= k)
        rows = work.write(rows.select("dataset", "src", "dst", "distance", "rank"), f"ring{level}")
        # within one cell of a point all neighbours up to ``side`` away were met
        done = rows.groupBy("dataset", "src").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where(F.lit(whole) | ((F.col("n") == k) & (F.col("far") < side))).select("dataset", "src")
        got = rows.join(done, ["dataset", "src"], "left_semi")
        out = got if out is None else out.unionByName(got)
        if whole:
            return out
        left = work.write(left.join(done.withColumnRenamed("src", "obs_id"), ["dataset", "obs_id"], "left_anti"), "left")
        if left.isEmpty():
            return out
        level = min(level - 1, left.agg(F.max("level")).first()[0])


def boundary(points: DataFrame, k: int = 6) -> DataFrame:
    """dataset, obs_id, is_boundary: whether any of the k nearest has another label. ``points`` also has label; null labels don't differ."""
    lab = points.select("dataset", "obs_id", "label")
    n = nearest(points, k).select("dataset", F.col("src").alias("obs_id"), "dst")
    n = n.join(lab, ["dataset", "obs_id"]).join(lab.select("dataset", F.col("obs_id").alias("dst"), F.col("label").alias("label2")), ["dataset", "dst"])
    return n.groupBy("dataset", "obs_id").agg(F.coalesce(F.bool_or(F.expr("label <> label2")), F.lit(False)).alias("is_boundary"))


def boundary_support(flags: DataFrame, support: DataFrame) -> DataFrame:
    """Median support of boundary and of inner observations."""
    s = flags.join(support, ["dataset", "obs_id"]).select("dataset", F.expr("CASE WHEN is_boundary THEN support END").alias("boundary"), F.expr("CASE WHEN NOT is_boundary THEN support END").alias("inner"), "is_boundary")
    q = quantiles(s, ["dataset"], {"boundary_median": ("boundary", 0.5), "inner_median": ("inner", 0.5)})
    n = s.groupBy("dataset").agg(F.count_if("is_boundary").alias("n_boundary"))
    return q.join(n, "dataset").select("dataset", "boundary_median", "inner_median", "n_boundary")


def geometry(points: DataFrame, radius: float) -> DataFrame:
    """Per dataset: median nearest distance, degree quartiles within the radius, isolated points."""
    near = quantiles(nearest(points, 1), ["dataset"], {"median_nearest": ("distance", 0.5)}).select("dataset", "median_nearest")
    d = degrees(points, radius)
    q = quantiles(d, ["dataset"], {"degree_q25": ("degree", 0.25), "degree_median": ("degree", 0.5), "degree_q75": ("degree", 0.75)}).withColumnRenamed("n__degree", "n")
    alone = d.groupBy("dataset").agg(F.count_if(F.col("degree") == 0).alias("n_isolated"))
    return q.join(alone, "dataset").join(near, "dataset", "left")


def edge_set(edges: DataFrame) -> DataFrame:
    """Canonical undirected edges: (dataset, lo, hi) once, no self loops."""
    return edges.where("src <> dst").select("dataset", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()


def edge_digest(edges: DataFrame) -> DataFrame:
    """Order-free digest of a dataset's canonical edges: their number and the sum and exclusive-or of edge hashes."""
    h = edge_set(edges).withColumn("h", F.xxhash64("lo", "hi"))
    return h.groupBy("dataset").agg(F.count("*").alias("n_edges"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor("h").alias("xor"))


def graph_metadata(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per dataset: vertices, edges, degree range, isolated vertices, connected components."""
    e = edge_set(edges)
    both = e.select("dataset", F.col("lo").alias("obs_id")).unionAll(e.select("dataset", F.col("hi").alias("obs_id")))
    deg = vertices.select("dataset", "obs_id").join(both.groupBy("dataset", "obs_id").agg(F.count("*").alias("degree")), ["dataset", "obs_id"], "left").select("dataset", "obs_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    # datasets may share ids: a vertex is the dataset's name and the id
    named = lambda c: F.to_json(F.struct(F.col("dataset").alias("d"), F.col(c).alias("o")))
    comp = connected_components(e.select(named("lo").alias("lo"), named("hi").alias("hi")), "lo", "hi").withColumnRenamed("id", "vertex")
    deg = deg.withColumn("vertex", named("obs_id")).join(comp, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    return deg.groupBy("dataset").agg(F.count("*").alias("n_vertices"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("n_isolated"), F.countDistinct("component").alias("n_components"))
