"""Column domains: attributes, their ordered products, and classes of attributes that mean the same."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from enum import Enum

from ..types import BaseType

_ids = itertools.count()


@dataclass(frozen=True)
class Attribute:
    """One named column domain. Two attributes of one name are different nodes."""

    name: str
    type: BaseType = field(default=BaseType.OBJECT, compare=False)
    id: int = field(default_factory=lambda: next(_ids))

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Concept:
    """A named class; its domain is the union of its members' domains."""

    name: str
    type: BaseType | None = field(default=None, compare=False)

    def __str__(self) -> str:
        return self.name


Atom = Attribute | Concept


@dataclass(frozen=True)
class Product:
    """An ordered tuple of two or more atoms."""

    atoms: tuple[Atom, ...]

    def __str__(self) -> str:
        return ";".join(map(str, self.atoms))


Node = Attribute | Concept | Product


def parts(node: Node) -> tuple[Atom, ...]:
    return node.atoms if isinstance(node, Product) else (node,)


def product(nodes: list[Node] | tuple[Node, ...]) -> Node:
    """Flattened product of nodes; of one atom, the atom."""
    atoms = tuple(a for n in nodes for a in parts(n))
    return atoms[0] if len(atoms) == 1 else Product(atoms)


def sublist_places(small: tuple, large: tuple) -> list[int] | None:
    """Places of small's items in large, in order, if small is an ordered sub-list of large."""
    out, at = [], 0
    for x in small:
        while at < len(large) and large[at] != x:
            at += 1
        if at == len(large):
            return None
        out.append(at)
        at += 1
    return out


class Cardinality(Enum):
    ONE_TO_ONE = "<-->"
    MANY_TO_ONE = "--->"
    ONE_TO_MANY = "<---"
    MANY_TO_MANY = "---"

    @property
    def functional(self) -> bool:
        """Whether the source determines the target."""
        return self in (Cardinality.ONE_TO_ONE, Cardinality.MANY_TO_ONE)

    @property
    def reversed(self) -> "Cardinality":
        swap = {Cardinality.MANY_TO_ONE: Cardinality.ONE_TO_MANY, Cardinality.ONE_TO_MANY: Cardinality.MANY_TO_ONE}
        return swap.get(self, self)

    def then(self, other: "Cardinality") -> "Cardinality":
        """Of a path that goes on with other: each direction is a function only if both steps are."""
        forward = self.functional and other.functional
        back = self.reversed.functional and other.reversed.functional
        return {(True, True): Cardinality.ONE_TO_ONE, (True, False): Cardinality.MANY_TO_ONE, (False, True): Cardinality.ONE_TO_MANY}.get((forward, back), Cardinality.MANY_TO_MANY)
