"""Matches that a stream of new edges completes, against a static graph.

The pattern's chain of equi-joins is stateless where one of its edges streams and everything else is static, so it runs as a
stream-static join in append mode, without a watermark. Patterns in which two edges would stream need state for both and
are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import EdgeTable, PropertyGraph
from ..pattern import Pattern
from ..plans.compile import match


def match_stream(graph: PropertyGraph, pattern: Pattern, label: str, edges: DataFrame, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
    """A streaming frame of the matches in which the pattern's one edge of ``label`` is bound to an edge of the stream (eid, src, dst, attributes)."""
    own = [e for e in pattern.edges.values() if e.label == label]
    if len(own) != 1:
        raise ValueError(f"the pattern must have one edge of {label}, it has {len(own)}")
    rest = [t for t in graph.edges if t.label != label]
    # vertices are looked up, as a stream promises nothing of its ends; the plan starts at the stream's own edge
    live = PropertyGraph(graph.spark, graph.vertices, [*rest, EdgeTable(label, edges, src_label, dst_label, integrity=False)])
    order = [own[0].src] + [v for v in (own[0].dst,) if v != own[0].src]
    while len(order) < len(pattern.vertices):
        near = [v for v in pattern.vertices if v not in order and set(pattern.neighbours(v)) & set(order)]
        order.append((near or [v for v in pattern.vertices if v not in order])[0])
    return match(live, pattern, order=order)
