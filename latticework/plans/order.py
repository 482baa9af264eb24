"""Matching orders.

Default: vertices are ranked by the class of their predicates (equality, range, inequality, none), then by
cost(v) = |label(v)| * neighbours(v) + sum over edges of min(|edge label|, |label(v)|), then by degree + 5 * neighbours, then
by id. From that ranking a connected order is taken: after the first vertex the best-ranked vertex next to those already
bound comes next, so no cross product arises inside a connected part; parts follow one another, the cheapest first."""

from __future__ import annotations

from ..pattern import Pattern

_RANK = {"=": 0, ">": 1, ">=": 1, "<": 1, "<=": 1, "!=": 2}


def predicate_class(p: Pattern, vid: str) -> int:
    return min((_RANK[q.op] for q in p.vertices[vid].preds), default=3)


def cost(p: Pattern, vid: str, stats: dict) -> int:
    own = stats.get("v_label_cnt", {}).get(p.vertices[vid].label, 0)
    edges = stats.get("e_label_cnt", {})
    return own * len(p.neighbours(vid)) + sum(min(edges.get(e.label, 0), own) for e in p.edges_of(vid))


def ranked(p: Pattern, stats: dict | None = None) -> list[str]:
    """All vertices by rank, whether connected or not."""
    stats = stats or {}
    return sorted(p.vertices, key=lambda v: (predicate_class(p, v), cost(p, v, stats), p.degree(v) + 5 * len(p.neighbours(v)), v))


def connected(p: Pattern, stats: dict | None = None) -> list[str]:
    """The ranking, constrained to keep each part connected."""
    place = {v: k for k, v in enumerate(ranked(p, stats))}
    out: list[str] = []
    for part in sorted(p.components(), key=lambda part: min(place[v] for v in part)):
        bound: set[str] = set()
        while len(bound) < len(part):
            near = {n for v in bound for n in p.neighbours(v)} - bound or set(part) - bound
            best = min(near, key=place.__getitem__)
            bound.add(best)
            out.append(best)
    return out


def checked(p: Pattern, order: list[str]) -> list[str]:
    if sorted(order) != sorted(p.vertices):
        raise ValueError(f"the order {order} is not a permutation of the pattern's vertices")
    return list(order)
