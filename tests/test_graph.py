"""Nodes, classes and path search."""

import pytest

from keyloom.errors import ClassClashError, ClassExistsError, CycleError, EdgeExistsError, EdgeMissingError, ManyPathsError, NodeExistsError, NodeMissingError, NoPathError
from keyloom.plans.graph import Graph
from keyloom.plans.nodes import Attribute, Cardinality as C, Concept, Product, parts, product, sublist_places


def graph(names, *edges):
    g = Graph()
    nodes = {n: Attribute(n) for n in names}
    for n in nodes.values():
        g.add_node(n)
    for a, b, *c in edges:
        g.add_edge(nodes[a], nodes[b], *c)
    return g, nodes


def shown(path):
    return [str(s) for s in path]


def test_cardinalities_compose():
    assert C.MANY_TO_ONE.then(C.MANY_TO_ONE) == C.MANY_TO_ONE
    assert C.ONE_TO_ONE.then(C.ONE_TO_MANY) == C.ONE_TO_MANY
    assert C.MANY_TO_ONE.then(C.ONE_TO_MANY) == C.MANY_TO_MANY
    assert C.MANY_TO_ONE.reversed == C.ONE_TO_MANY and C.ONE_TO_ONE.reversed == C.ONE_TO_ONE


def test_products_are_ordered_and_flat():
    u, v, w = map(Attribute, "uvw")
    assert product([product([u, v]), w]) == Product((u, v, w)) != product([v, u, w])
    assert parts(product([u])) == (u,)
    assert Attribute("u") != u
    assert sublist_places((u, w), (u, v, w)) == [0, 2] and sublist_places((w, u), (u, v, w)) is None


def test_paths_of_length_zero_and_over_a_class():
    g, n = graph("uvw", ("v", "w", C.ONE_TO_ONE))
    g.blend(n["u"], n["v"])
    assert g.path(n["u"], n["u"]) == []
    assert shown(g.path(n["u"], n["v"])) == ["u === v"]
    assert shown(g.path(n["u"], n["w"])) == ["u === v", "v <--> w"]


def test_products_hop_part_by_part():
    g, n = graph("uabw")
    g.blend(n["a"], n["b"])
    g.add_edge(product([n["u"], n["b"]]), n["w"], C.MANY_TO_ONE)
    path = g.path(product([n["u"], n["a"]]), n["w"])
    assert shown(path) == ["u;a === u;b", "u;b ---> w"]
    assert g.cardinality(path) == C.MANY_TO_ONE
    assert shown(g.path(n["u"], n["w"])) == ["u <--- u;b", "u;b ---> w"]  # expansion


def test_projections_are_not_searched():
    g, n = graph("uvw", ("v", "w"))
    with pytest.raises(NoPathError):
        g.path(product([n["u"], n["v"]]), n["w"])


def test_ties_raise_and_shorter_paths_win():
    g, n = graph("uvwx", ("u", "v"), ("u", "w"), ("v", "x"), ("w", "x"))
    with pytest.raises(ManyPathsError):
        g.path(n["u"], n["x"])
    assert shown(g.path(n["u"], n["x"], [n["w"]])) == ["u --- w", "w --- x"]
    g, n = graph("uvwxy", ("u", "v"), ("u", "w"), ("v", "y", C.ONE_TO_MANY), ("w", "x", C.ONE_TO_ONE), ("x", "y"))
    assert shown(g.path(n["u"], n["y"])) == ["u --- v", "v <--- y"]


def test_waypoints_must_not_turn_back():
    g, n = graph("uv", ("u", "v"))
    with pytest.raises(CycleError):
        g.path(n["u"], n["u"], [n["v"]])


def test_classes_join_whole():
    g, n = graph("abcd")
    k = Concept("K")
    g.add_concept(k)
    g.blend(n["a"], n["b"])
    g.blend(n["c"], n["d"])
    g.blend(n["b"], n["c"], k)
    assert g.are_equal(n["a"], n["d"]) and g.concept_of(n["a"]) == k
    other = Concept("L")
    g.add_concept(other)
    with pytest.raises(ClassClashError):
        g.blend(n["a"], n["d"], other)
    with pytest.raises(ClassExistsError):
        g.add_concept(Concept("K"))


def test_errors():
    g, n = graph("uv", ("u", "v"))
    with pytest.raises(NodeExistsError):
        g.add_node(n["u"])
    with pytest.raises(EdgeExistsError):
        g.add_edge(n["v"], n["u"])
    with pytest.raises(EdgeMissingError):
        g.edge(n["u"], n["u"])
    with pytest.raises(NodeMissingError):
        g.path(Attribute("x"), n["u"])
    g.add_edge(n["u"], n["u"])  # an edge to itself says nothing
    assert "u --- v" in str(g)
