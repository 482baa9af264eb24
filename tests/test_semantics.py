"""Micro graphs: one test for each rule of matching."""

import itertools
import random

import pytest

from latticework.pattern import Pred, build
from latticework.plans.compile import match
from latticework.sources.memory import graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parallel_edges_each_give_a_row(spark):
    g = graph(spark, [("a1", "A"), ("b1", "B")], [("e1", "a1", "b1", "R"), ("e2", "a1", "b1", "R")])
    assert rows(match(g, build([("a", "A"), ("b", "B")], [("x", "a", "b", "R")]))) == [("a1", "b1", "e1"), ("a1", "b1", "e2")]


def test_two_edges_between_a_pair_are_conjoined(spark):
    g = graph(spark, [(f"p{k}", "P") for k in (1, 2, 3)], [("e1", "p1", "p2", "knows"), ("e2", "p2", "p1", "knows"), ("e3", "p1", "p3", "knows")])
    p = build([("p", "P"), ("q", "P")], [("x", "p", "q", "knows"), ("y", "q", "p", "knows")])
    assert [r[:2] for r in rows(match(g, p))] == [("p1", "p2"), ("p2", "p1")]


def test_triangle(spark):
    v = [(f"{c}{k}", c) for c in ("Red", "Blue", "Green") for k in (1, 2)]
    e = [(f"{a}{k}", f"{a}{k}", f"{b}{k}", "Edge") for k in (1, 2) for a, b in (("Red", "Blue"), ("Blue", "Green"), ("Green", "Red")) if (k, a) != (2, "Red")]
    p = build([("red", "Red"), ("blue", "Blue"), ("green", "Green")], [("a", "red", "blue", "Edge"), ("b", "blue", "green", "Edge"), ("c", "green", "red", "Edge")])
    assert len(rows(match(graph(spark, v, e), p))) == 1


def test_forest(spark):
    v = [("r1", "Red"), ("r2", "Red"), ("b", "Blue"), ("g", "Green")]
    e = [("x", "r1", "b", "Edge"), ("y", "b", "g", "Edge"), ("z", "g", "r1", "Edge")]
    p = build([("red", "Red"), ("blue", "Blue"), ("green", "Green"), ("other", "Red")], [("a", "red", "blue", "Edge"), ("b", "blue", "green", "Edge"), ("c", "green", "red", "Edge")])
    g = graph(spark, v, e)
    assert len(rows(match(g, p))) == 2 and len(rows(match(g, p, vertex_injective=True))) == 1


def test_no_relationship_twice(spark):
    g = graph(spark, [("o1", "O"), ("o2", "O"), ("c", "C")], [("e1", "o1", "c", "by"), ("e2", "o2", "c", "by")])
    got = rows(match(g, build([("a", "O"), ("b", "O"), ("c", "C")], [("x", "a", "c", "by"), ("y", "b", "c", "by")])))
    assert [r[:2] for r in got] == [("o1", "o2"), ("o2", "o1")]


def test_vertices_may_coincide_unless_asked(spark):
    g = graph(spark, [("u", "Person"), ("w", "Post")], [("e1", "u", "w", "likes"), ("e2", "w", "u", "hasCreator")])
    p = build([("p", "Person"), ("w", "Post"), ("q", "Person")], [("x", "p", "w", "likes"), ("y", "w", "q", "hasCreator")])
    for order in itertools.permutations(p.vertices):
        assert len(rows(match(g, p, order=list(order)))) == 1 and not rows(match(g, p, order=list(order), vertex_injective=True))


def test_empty_branch_and_absent_label(spark):
    g = graph(spark, [("a", "A"), ("b", "B"), ("c", "C")], [("e", "a", "b", "R")])
    p = build([("x", "A"), ("y", "B"), ("z", "C")], [("i", "x", "y", "R"), ("j", "y", "z", "R")])
    assert rows(match(g, p)) == []
    none = match(g, build([("x", "A"), ("y", "Z")], [("i", "x", "y", "R")]))
    assert none.columns == ["v_x", "v_y", "e_i"] and rows(none) == []


def test_self_loop(spark):
    g = graph(spark, [("v", "V"), ("w", "V")], [("l", "v", "v", "R"), ("m", "v", "w", "R")])
    assert rows(match(g, build([("a", "V")], [("x", "a", "a", "R")]))) == [("v", "l")]


@pytest.mark.parametrize("op", ["=", "!=", "<", "<=", ">", ">="])
def test_mixed_types_and_missing_values(spark, op):
    g = graph(spark, [("a", "A", {"k": 5}), ("b", "A", {"k": "5"}), ("c", "A", {}), ("d", "A", {"k": 4.5})])
    got = {r[0] for r in rows(match(g, build([("x", "A")], (), [("x", "k", op, 5)])))}
    assert got == {"=": {"a"}, "!=": {"d"}, "<": {"d"}, "<=": {"a", "d"}, ">": set(), ">=": {"a"}}[op]
    if op in ("=", "!="):
        assert {r[0] for r in rows(match(g, build([("x", "A")], (), [("x", "k", op, "5")])))} == ({"b"} if op == "=" else set())


def test_numbers_widen_and_never_meet_texts(spark):
    g = graph(spark, [("a", "A", {"f": 3.0, "s": "3"}), ("b", "A", {"f": None, "s": "x"})])
    assert [r[0] for r in rows(match(g, build([("x", "A")], (), [("x", "f", "=", 3)])))] == ["a"]
    assert rows(match(g, build([("x", "A")], (), [("x", "s", "!=", 3)]))) == []
    assert rows(match(g, build([("x", "A")], (), [("x", "f", "!=", 3)]))) == []
    assert rows(match(g, build([("x", "A")], (), [("x", "nowhere", "!=", 3)]))) == []


def test_same_edge_label_between_other_labels(spark):
    g = graph(spark, [("c", "C"), ("s", "S"), ("n", "N")], [("e1", "c", "n", "in"), ("e2", "s", "n", "in")])
    p = build([("c", "C"), ("s", "S"), ("n", "N")], [("x", "c", "n", "in"), ("y", "s", "n", "in")])
    assert rows(match(g, p)) == [("c", "n", "s", "e1", "e2")]


def test_repeated_runs_are_pure(spark):
    g = graph(spark, [("a", "A"), ("b", "B")], [("e", "a", "b", "R")])
    p = build([("x", "A"), ("y", "B")], [("i", "x", "y", "R")])
    df = match(g, p)
    assert rows(df) == rows(df) == rows(match(g, p))


def brute(vertices, edges, p, injective=False):
    """Nested loops over all assignments."""
    label = {v[0]: v[1] for v in vertices}
    attrs = {v[0]: v[2] for v in vertices} | {e[0]: e[4] for e in edges}
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    holds = lambda i, preds: all(attrs[i].get(q.key) is not None and ops[q.op](attrs[i][q.key], q.value) for q in preds)
    vs, es, out = sorted(p.vertices), sorted(p.edges), []
    for vb in itertools.product(*([v[0] for v in vertices if v[1] == p.vertices[k].label and holds(v[0], p.vertices[k].preds)] for k in vs)):
        at = dict(zip(vs, vb))
        if injective and any(at[a] == at[b] and label[at[a]] == label[at[b]] for a, b in itertools.combinations(vs, 2)):
            continue
        for eb in itertools.product(*([e[0] for e in edges if e[3] == p.edges[k].label and e[1] == at[p.edges[k].src] and e[2] == at[p.edges[k].dst] and holds(e[0], p.edges[k].preds)] for k in es)):
            if len(set(eb)) == len(eb):
                out.append((*vb, *eb))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_random_graphs_against_nested_loops_in_every_order(spark, seed):
    r = random.Random(seed)
    vertices = [(f"n{k}", r.choice("AB"), {"k": r.choice([1, 2, 3, None])}) for k in range(6)]
    edges = [(f"e{k}", f"n{r.randrange(6)}", f"n{r.randrange(6)}", r.choice("RS"), {"w": r.randrange(3)}) for k in range(14)]
    n = r.randint(2, 4)
    names = [f"v{k}" for k in range(n)]
    pes = [(f"x{k}", r.choice(names), r.choice(names), r.choice("RS")) for k in range(r.randint(1, 4))]
    preds = [(r.choice(names), "k", r.choice(["=", "!=", "<", ">="]), 2)] if r.random() < 0.7 else []
    preds += [(pes[0][0], "w", "<=", 1)] if r.random() < 0.5 else []
    p = build([(v, r.choice("AB")) for v in names], pes, preds)
    g = graph(spark, vertices, edges)
    want = brute(vertices, edges, p)
    orders = list(itertools.permutations(names))
    for order in [None, *r.sample(orders, min(3, len(orders)))]:
        assert rows(match(g, p, order=list(order) if order else None)) == want
    assert rows(match(g, p, vertex_injective=True)) == brute(vertices, edges, p, True)
