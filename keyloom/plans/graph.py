"""The dependency graph and its path search."""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

from ..errors import ClassClashError, ClassExistsError, ClassMissingError, CycleError, EdgeExistsError, EdgeMissingError, ManyPathsError, NodeExistsError, NodeMissingError, NoPathError, TypeMismatchError
from .nodes import Atom, Attribute, Cardinality, Concept, Node, parts, product, sublist_places


@dataclass(frozen=True)
class Step:
    """One hop of a path: to a node of the same class (equal), or along a dependency."""

    source: Node
    target: Node
    cardinality: Cardinality
    equal: bool = False

    def __str__(self) -> str:
        return f"{self.source} {'===' if self.equal else self.cardinality.value} {self.target}"


class Graph:
    def __init__(self):
        self.atoms: dict[Atom, None] = {}
        self.edges: dict[tuple[Node, Node], Cardinality] = {}
        self.near: dict[Node, dict[Node, Cardinality]] = {}
        self.parent: dict[Atom, Atom] = {}
        self.named: dict[Atom, Concept] = {}

    # nodes and edges

    def add_node(self, node: Atom) -> None:
        if node in self.atoms:
            raise NodeExistsError(f"{node} is in the schema already")
        self.atoms[node] = None
        self.parent[node] = node

    def add_concept(self, concept: Concept) -> None:
        if concept in self.atoms:
            raise ClassExistsError(f"class {concept} exists already")
        self.add_node(concept)
        self.named[concept] = concept

    def check(self, node: Node) -> None:
        for atom in parts(node):
            if atom not in self.atoms:
                kind = ClassMissingError if isinstance(atom, Concept) else NodeMissingError
                raise kind(f"{atom} is not in the schema")

    def has_edge(self, source: Node, target: Node) -> bool:
        return (source, target) in self.edges

    def edge(self, source: Node, target: Node) -> Cardinality:
        if not self.has_edge(source, target):
            raise EdgeMissingError(f"no dependency {source} -> {target}")
        return self.edges[source, target]

    def add_edge(self, source: Node, target: Node, cardinality: Cardinality = Cardinality.MANY_TO_MANY) -> None:
        self.check(source)
        self.check(target)
        if source == target:
            return
        if (source, target) in self.edges:
            raise EdgeExistsError(f"{source} -> {target} exists already")
        for a, b, c in ((source, target, cardinality), (target, source, cardinality.reversed)):
            self.edges[a, b] = c
            self.near.setdefault(a, {})[b] = c

    # classes

    def root(self, atom: Atom) -> Atom:
        while self.parent[atom] != atom:
            self.parent[atom] = self.parent[self.parent[atom]]
            atom = self.parent[atom]
        return atom

    def concept_of(self, atom: Atom) -> Concept | None:
        return self.named.get(self.root(atom))

    def blend(self, a: Atom, b: Atom, under: Concept | None = None) -> None:
        """Put a and b in one class. Both classes are joined whole, and a named class keeps its name."""
        for x in (a, b, *([under] if under else [])):
            self.check(x)
        if a.type is not None and b.type is not None and a.type != b.type:
            raise TypeMismatchError(f"{a} is {a.type.value}, {b} is {b.type.value}")
        names = {n for n in (self.concept_of(a), self.concept_of(b), under) if n}
        if len(names) > 1:
            raise ClassClashError(f"{a} and {b} belong to different classes: {', '.join(sorted(map(str, names)))}")
        for x in [b, *([under] if under else [])]:
            self.parent[self.root(x)] = self.root(a)
        if names:
            self.named[self.root(a)] = names.pop()

    def equals(self, atom: Atom) -> list[Atom]:
        """Members of the atom's class, in order of registration."""
        self.check(atom)
        top = self.root(atom)
        return [x for x in self.atoms if self.root(x) == top]

    def equivalent(self, node: Node) -> list[Node]:
        return [product(x) for x in itertools.product(*map(self.equals, parts(node)))]

    def are_equal(self, a: Node, b: Node) -> bool:
        self.check(a)
        self.check(b)
        x, y = parts(a), parts(b)
        return len(x) == len(y) and all(self.root(i) == self.root(j) for i, j in zip(x, y))

    # paths

    def neighbours(self, node: Node) -> dict[Node, Cardinality]:
        """Dependencies either way, and any stored key of which node is an ordered sub-list: a step there ranges over its other parts."""
        found = dict(self.near.get(node, {}))
        own = parts(node)
        for key in self.near:
            if key not in found and key != node and len(parts(key)) > len(own) and sublist_places(own, parts(key)) is not None:
                found[key] = Cardinality.ONE_TO_MANY
        return found

    def _leg(self, start: Node, goal: Node) -> list[Step]:
        """The unique cheapest path; a class hop and a dependency cost 1 each."""
        order = itertools.count()
        heap: list[tuple[int, int, Node, tuple[Step, ...]]] = [(0, next(order), start, ())]
        seen: set[Node] = {start}
        found: list[tuple[Step, ...]] = []
        least = None
        while heap:
            cost, _, node, path = heapq.heappop(heap)
            if least is not None and cost > least:
                break
            same = self.equivalent(node)
            seen.update(same)
            for other in same:
                hop = () if other == node else (Step(node, other, Cardinality.ONE_TO_ONE, True),)
                total = cost + len(hop)
                if other == goal and (least is None or total <= least):
                    found = [*(found if total == least else []), path + hop]
                    least = total
                for near, cardinality in self.neighbours(other).items():
                    if near not in seen:
                        heapq.heappush(heap, (total + 1, next(order), near, (*path, *hop, Step(other, near, cardinality))))
        if not found:
            raise NoPathError(f"no path from {start} to {goal}; a projection on the way has to be given as a waypoint")
        if len(found) > 1:
            shown = "; ".join("[" + ", ".join(map(str, p)) + "]" for p in found)
            raise ManyPathsError(f"several shortest paths from {start} to {goal}: {shown}")
        return list(found[0])

    def path(self, start: Node, goal: Node, via: list[Node] | None = None) -> list[Step]:
        """Shortest path through the waypoints in their order; no leg may come back to a node met before."""
        for node in (start, goal, *(via or [])):
            self.check(node)
        seen, steps, at = {start}, [], start
        for end in [*(via or []), goal]:
            leg = self._leg(at, end)
            met = {s.target for s in leg}
            if met & seen:
                raise CycleError(f"the path from {start} to {goal} meets {', '.join(sorted(map(str, met & seen)))} twice")
            seen |= met
            steps += leg
            at = end
        return steps

    @staticmethod
    def cardinality(path: list[Step]) -> Cardinality:
        out = Cardinality.ONE_TO_ONE
        for step in path:
            out = out.then(step.cardinality)
        return out

    def __str__(self) -> str:
        lines = ["dependencies"]
        for node, near in self.near.items():
            lines += [f"  {node} {c.value} {other}" for other, c in near.items()]
        lines.append("classes")
        done: set[Atom] = set()
        for atom in self.atoms:
            top = self.root(atom)
            members = [x for x in self.equals(atom) if isinstance(x, Attribute)]
            if top not in done and (len(members) > 1 or top in self.named):
                lines.append(f"  {self.named.get(top, '-')}: {', '.join(map(str, members))}")
            done.add(top)
        return "\n".join(lines)
