"""Point lookups, label scans and adjacency, as joins and filters on a graph's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..pattern import Pred


def get_vertex(g: PropertyGraph, vid: str) -> DataFrame:
    return g.vertex(vid)


def scan_vertices(g: PropertyGraph, label: str, *preds: Pred) -> DataFrame:
    return g.vertices_of(label, preds)


def scan_edges(g: PropertyGraph, label: str, *preds: Pred) -> DataFrame:
    return g.edges_of(label, preds=preds)


def _adjacent(g, frontier, label, side, preds, far_label, far_preds):
    far = "dst" if side == "src" else "src"
    ends = (None, far_label) if side == "src" else (far_label, None)
    edges = g.edges_of(label, *ends, preds)
    if far_label is not None:
        edges = edges.join(g.vertices_of(far_label, far_preds).select(F.col("vid").alias(far)), far, "left_semi")
    return edges.join(frontier.select(F.col("vid").alias(side)).distinct(), side, "left_semi")


def out_edges(g: PropertyGraph, frontier: DataFrame, label: str, preds: tuple[Pred, ...] = (), dst_label: str | None = None, dst_preds: tuple[Pred, ...] = ()) -> DataFrame:
    """Edges that leave a vertex of ``frontier(vid)``; with ``dst_label`` those alone whose far end is such a vertex."""
    return _adjacent(g, frontier, label, "src", preds, dst_label, dst_preds)


def in_edges(g: PropertyGraph, frontier: DataFrame, label: str, preds: tuple[Pred, ...] = (), src_label: str | None = None, src_preds: tuple[Pred, ...] = ()) -> DataFrame:
    """Edges that enter a vertex of ``frontier(vid)``; with ``src_label`` those alone whose far end is such a vertex."""
    return _adjacent(g, frontier, label, "dst", preds, src_label, src_preds)


def degrees(edges: DataFrame) -> DataFrame:
    """(vid, out_degree, in_degree) of every end of the edges, from one partial aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.vid").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def common_neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersection of adjacency: (a, b, target) for frames ``left(a, target)`` and ``right(b, target)``; equal rows count once."""
    return left.distinct().join(right.distinct(), "target").select("a", "b", "target")


def adjacency_arrays(edges: DataFrame, side: str = "src") -> DataFrame:
    """(vid, targets): each vertex's distinct neighbours as a sorted array, for dense cyclic patterns over bounded degrees."""
    far = "dst" if side == "src" else "src"
    return edges.groupBy(F.col(side).alias("vid")).agg(F.sort_array(F.collect_set(far)).alias("targets"))


def triangles_by_arrays(ab: DataFrame, ac: DataFrame, bc: DataFrame) -> DataFrame:
    """(a, b, c) with edges a->b, a->c and b->c, closing by array intersection in place of a third join."""
    b_of, c_of = ab.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct(), adjacency_arrays(ac).withColumnRenamed("vid", "a").withColumnRenamed("targets", "ta")
    far = adjacency_arrays(bc).withColumnRenamed("vid", "b").withColumnRenamed("targets", "tb")
    return b_of.join(c_of, "a").join(far, "b").select("a", "b", F.explode(F.array_intersect("ta", "tb")).alias("c"))
