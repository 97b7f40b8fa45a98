"""Connected components and edge utilities, as joins and aggregates on edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedquorum.plans.shipping import ship
from seedquorum.plans.workspace import Workspace

#: Edges that a task contracts at a time.
CHUNK = 1 << 20


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected edges (a < b), repeated ones too; self loops and edges with a null end go."""
    a, b = F.least(src, dst), F.greatest(src, dst)
    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(a.alias("a"), b.alias("b"))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges (a, b), as edges from each component's smallest vertex to its others."""
    vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(vertices))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        for end in (x, y):
            np.minimum.at(new, up[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            break
        up = new
    child = np.flatnonzero(up != np.arange(len(up)))
    return vertices[up[child]], vertices[child]


def _contract(batches):
    """Any edges may give way to their components' stars: the rest of the graph can't tell."""
    kept, n = [], 0

    def out():
        a, b = (np.concatenate([k[i].to_numpy(zero_copy_only=False) for k in kept]) for i in (0, 1))
        kind = kept[0][0].type
        kept.clear()
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v in stars(a, b)], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            kept.append((batch.column("a"), batch.column("b")))
            n += batch.num_rows
        if n >= CHUNK:
            yield from out()
            n = 0
    if kept:
        yield from out()


def _contracted(e: DataFrame) -> DataFrame:
    return e.mapInArrow(_contract, e.schema)


def _large_star(e: DataFrame, work: Workspace) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = work.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large_star")
    return _contracted(both.where("v > u").join(low, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")))


def _small_star(e: DataFrame, work: Workspace) -> DataFrame:
    low = work.write(e.groupBy("b").agg(F.min("a").alias("m")), "small_star")
    moved = e.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return _contracted(moved.unionByName(low.select(F.col("m").alias("a"), "b")))


def _are_stars(e: DataFrame) -> bool:
    """Whether each vertex is a centre, or a leaf of one centre."""
    ends = e.select(F.col("b").alias("v"), F.col("a").alias("centre")).unionByName(e.select(F.col("a").alias("v"), F.lit(None).cast(e.schema["a"].dataType).alias("centre")))
    roles = ends.groupBy("v").agg(F.min("centre").alias("low"), F.max("centre").alias("high"), F.count_if(F.col("centre").isNull()).alias("centred"))
    return roles.where("low IS NOT NULL AND (low <> high OR centred > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every vertex that has an edge; component is its smallest reachable id.

    Alternating large-star and small-star rounds; each is a join of edges with a written table of per-vertex minima, so no
    neighbour list is ever gathered in one task, and Spark can split a hub's edges between tasks. Before they are written, each task's own edges
    give way to their components' stars, which leaves fewer edges and rounds. O(log n) rounds in practice, until all are stars.
    An empty edge table gives an empty result; repeated edges and self loops don't matter.
    """
    work = Workspace(edges.sparkSession, "components")
    ship(edges.sparkSession)
    e = work.write(_contracted(undirected(edges, src, dst)), "edges")
    while not _are_stars(e):
        e = work.write(_large_star(e, work), "edges")
        e = work.write(_small_star(e, work), "edges")
    e = e.distinct()
    kept = e.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return kept.unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
