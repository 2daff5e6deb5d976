"""The unit of data: one value column as a relation over its keys."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .nodes import Atom


@dataclass(frozen=True)
class Base:
    """That a relation's rows are those of one registered frame, read off by column.

    columns: (key, source column); members: keys that are restricted to a node's
    domain; needed: further source columns that must not be null. Relations that
    agree in these are read by one scan, however many values they have.
    """

    frame: DataFrame
    columns: tuple[tuple[str, str], ...]
    value: str
    members: tuple[tuple[str, Atom], ...] = ()
    needed: tuple[str, ...] = ()

    @property
    def scan(self) -> tuple:
        return id(self.frame), frozenset(self.columns), frozenset(self.members), frozenset(self.needed)


@dataclass(frozen=True)
class Relation:
    """Rows over strong keys, hidden keys and the value; none is null, and the keys determine the value."""

    df: DataFrame
    strong: tuple[str, ...]
    hidden: tuple[str, ...]
    value: str
    base: Base | None = None
    #: How many of its table's filters the rows have been through.
    seen: int = 0

    @property
    def keys(self) -> tuple[str, ...]:
        return self.strong + self.hidden

    def renamed(self, names: dict[str, str]) -> "Relation":
        """With columns under other names; the others stay."""
        if not any(c in names for c in (*self.keys, self.value)):
            return self
        new = lambda c: names.get(c, c)
        base = self.base and replace(self.base, columns=tuple((new(k), c) for k, c in self.base.columns), members=tuple((new(k), a) for k, a in self.base.members))
        df = self.df.select(*[F.col(quoted(c)).alias(new(c)) for c in (*self.keys, self.value)])
        return Relation(df, tuple(map(new, self.strong)), tuple(map(new, self.hidden)), new(self.value), base, self.seen)

    def moved(self, name: str, hide: bool) -> "Relation":
        """With a key hidden or shown: rows stay as they are."""
        if hide and name in self.strong:
            return replace(self, strong=tuple(k for k in self.strong if k != name), hidden=(*self.hidden, name))
        if not hide and name in self.hidden:
            return replace(self, hidden=tuple(k for k in self.hidden if k != name), strong=(*self.strong, name))
        return self

    def semi(self, other: DataFrame, on: list[str]) -> "Relation":
        """Rows that other has keys for."""
        if not on:
            return self
        rows = self.df.join(other.select(*map(quoted, on)).distinct(), on, "left_semi")
        return replace(self, df=rows.select(*map(quoted, (*self.keys, self.value))), base=None)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def natural(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all names that both have; without such a name, every row meets every row."""
    if left is None:
        return right
    on = [c for c in left.columns if c in right.columns]
    return left.join(right, on, how) if on else left.crossJoin(right)


def present(df: DataFrame, names: list[str] | None = None, some: bool = False) -> DataFrame:
    """Rows with a value in all (or in some) of the named columns."""
    tests = [col(n).isNotNull() for n in (df.columns if names is None else names)]
    return df.filter(reduce(or_ if some else and_, tests))
