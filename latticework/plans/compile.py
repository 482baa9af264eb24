"""Plans to DataFrames: a chain of equi-joins that binds ids, with columns ``v_<vertex>`` and ``e_<edge>``.

* A vertex is looked up in its frame only if it has predicates or its edges' ends are not known to be of its label; then a semi
  join filters the edges before they meet the bindings, so what is carried stays small.
* An edge between bound vertices is joined on both ends, never expanded and filtered.
* Relationships are pairwise distinct: for two pattern edges of one label whose frames can hold the same edge, ``e_i <> e_j`` is
  applied as soon as the second is bound.
* Only ids are carried; attributes are fetched after matching. Where a graph has 64-bit keys, and each pattern edge lies in one table,
  keys are carried in place of ids, and ids are rendered from the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import vid
from ..functions.predicates import apply
from ..model import PropertyGraph
from ..pattern import Pattern, parse
from .plan import Plan, make_plan


class _Part:
    """Bindings of one connected part of the pattern."""

    def __init__(self, frame: DataFrame, vertices: set[str], edges: list[str]):
        self.frame, self.vertices, self.edges = frame, vertices, edges


class Compiler:
    def __init__(self, graph: PropertyGraph, plan: Plan, vertex_injective: bool = False, join_hint: str | None = None):
        self.g, self.plan, self.p = graph, plan, plan.pattern
        self.injective, self.hint = vertex_injective, join_hint
        self.parts: list[_Part] = []
        of = lambda e: graph.tables_of(e.label, self.p.vertices[e.src].label, self.p.vertices[e.dst].label)
        self.tables = {e.eid: found[0] for e in self.p.edges.values() if len(found := of(e)) == 1 and found[0].keyed and found[0].typed("src") and found[0].typed("dst")}
        self.keyed = graph.key is not None and len(self.tables) == len(self.p.edges) and all(v.label in graph.vertices for v in self.p.vertices.values())

    def _join(self, a: DataFrame, b: DataFrame, on) -> DataFrame:
        return a.join(b.hint(self.hint) if self.hint else b, on)

    def _vertex(self, name: str) -> DataFrame:
        v = self.p.vertices[name]
        return self.g.vertices_of(v.label, v.preds).select(F.col(self.g.key if self.keyed else "vid").alias(f"v_{name}"))

    def _needs_lookup(self, vid: str, eid: str) -> bool:
        v, e = self.p.vertices[vid], self.p.edges[eid]
        src, dst = self.p.vertices[e.src].label, self.p.vertices[e.dst].label
        return bool(v.preds) or not self.g.ends_known(e.label, src, dst, "src" if vid == e.src else "dst")

    def _edge(self, eid: str) -> DataFrame:
        e = self.p.edges[eid]
        df = apply(self.tables[eid].keyed(), e.preds) if self.keyed else self.g.edges_of(e.label, self.p.vertices[e.src].label, self.p.vertices[e.dst].label, e.preds)
        if e.src == e.dst:
            return df.filter("src = dst").select(F.col("src").alias(f"v_{e.src}"), F.col("eid").alias(f"e_{eid}"))
        return df.select(F.col("src").alias(f"v_{e.src}"), F.col("dst").alias(f"v_{e.dst}"), F.col("eid").alias(f"e_{eid}"))

    def _same_edges(self, a: str, b: str) -> bool:
        """Whether one data edge can be bound to both pattern edges."""
        x, y = self.p.edges[a], self.p.edges[b]
        ends = lambda e: (self.p.vertices[e.src].label, self.p.vertices[e.dst].label)
        return x.label == y.label and ends(x) == ends(y)

    def _bound(self, part: _Part, frame: DataFrame, vertex: str | None, eid: str | None) -> None:
        if eid is not None:
            for other in part.edges:
                if self._same_edges(eid, other):
                    frame = frame.filter(F.col(f"`e_{eid}`") != F.col(f"`e_{other}`"))
            part.edges.append(eid)
        if vertex is not None:
            if self.injective:
                for other in sorted(part.vertices):
                    if self.p.vertices[other].label == self.p.vertices[vertex].label:
                        frame = frame.filter(F.col(f"`v_{vertex}`") != F.col(f"`v_{other}`"))
            part.vertices.add(vertex)
        part.frame = frame

    def _part(self, vid: str) -> _Part:
        return next(x for x in self.parts if vid in x.vertices)

    def _meet(self, a: _Part, b: _Part, frame: DataFrame) -> _Part:
        """Two parts joined in ``frame``: the filters between them are applied."""
        for x in a.edges:
            for y in b.edges:
                if self._same_edges(x, y):
                    frame = frame.filter(F.col(f"`e_{x}`") != F.col(f"`e_{y}`"))
        if self.injective:
            for x in sorted(a.vertices):
                for y in sorted(b.vertices):
                    if self.p.vertices[x].label == self.p.vertices[y].label:
                        frame = frame.filter(F.col(f"`v_{x}`") != F.col(f"`v_{y}`"))
        self.parts.remove(b)
        a.frame, a.vertices, a.edges = frame, a.vertices | b.vertices, a.edges + b.edges
        return a

    def run(self) -> DataFrame:
        for s in self.plan.steps:
            if s.kind == "merge":  # what is still apart is disconnected: a cross product is what the pattern asks for
                a, b = self.parts[0], self.parts[1]
                self._meet(a, b, a.frame.crossJoin(b.frame))
            elif s.kind == "scan":
                self.parts.append(_Part(self._vertex(s.vertex), {s.vertex}, []))
            elif s.kind == "expand":
                e = self.p.edges[s.edge]
                edges = self._edge(s.edge)
                if self._needs_lookup(s.vertex, s.edge):
                    edges = edges.join(self._vertex(s.vertex), f"v_{s.vertex}", "left_semi")
                part = self._part(e.other(s.vertex))
                self._bound(part, self._join(part.frame, edges, f"v_{e.other(s.vertex)}"), s.vertex, s.edge)
            elif s.kind == "close":
                e = self.p.edges[s.edge]
                a, b = self._part(e.src), self._part(e.dst)
                edges = self._edge(s.edge)
                if a is b:
                    self._bound(a, self._join(a.frame, edges, [f"v_{e.src}"] + [f"v_{e.dst}"] * (e.src != e.dst)), None, s.edge)
                else:  # the edge joins two parts
                    self._bound(a, self._join(a.frame, edges, f"v_{e.src}"), None, s.edge)
                    self._meet(a, b, self._join(a.frame, b.frame, f"v_{e.dst}"))
        out = self.parts[0].frame
        if self.keyed:
            out = out.select(*(vid(v.label, f"v_{v.vid}").alias(f"v_{v.vid}") for v in self.p.vertices.values()), *(t.render(F.col(f"`e_{e}`")).alias(f"e_{e}") for e, t in self.tables.items()))
        return out.select(*(F.col(f"`v_{v}`") for v in sorted(self.p.vertices)), *(F.col(f"`e_{e}`") for e in sorted(self.p.edges)))


def match(graph: PropertyGraph, pattern: Pattern | str, order: list[str] | None = None, stats: dict | None = None, vertex_injective: bool = False, optimize: bool = True, join_hint: str | None = None) -> DataFrame:
    """Every complete match of the pattern, one row each: vertices may coincide (unless ``vertex_injective``), edges may not.

    The result is an ordinary frame; an absent label or a failing predicate gives no rows under the same schema."""
    p = parse(pattern) if isinstance(pattern, str) else pattern
    return run_plan(graph, make_plan(p, stats, order, optimize), vertex_injective, join_hint)


def run_plan(graph: PropertyGraph, plan: Plan, vertex_injective: bool = False, join_hint: str | None = None) -> DataFrame:
    return Compiler(graph, plan, vertex_injective, join_hint).run()
