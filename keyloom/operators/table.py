"""Tables: keys, values over them, and the operations that reshape them.

Reshaping changes metadata alone. Only infer, compose, mutate and the inversions
build new relations, and all of them are lazy Spark plans.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window, functions as F

from ..errors import ColumnError
from ..functions.expressions import Aggregate, Expr, Extend, Literal, Ref, leaves, to_spark, wrap
from ..plans.nodes import Atom, Attribute, Concept, parts, product, sublist_places
from ..plans.relation import Base, Relation, col, natural, present, quoted
from ..types import BaseType

if TYPE_CHECKING:
    from ..plans.graph import Step
    from ..sources.schema import Schema

_temporary = itertools.count()


def _temp() -> str:
    return f"__{next(_temporary)}"


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, or name_1, name_2, ... if that is taken."""
    taken = set(taken)
    if name not in taken:
        return name
    return next(f"{name}_{i}" for i in itertools.count(1) if f"{name}_{i}" not in taken)


@dataclass(frozen=True)
class Value:
    node: Atom
    type: BaseType
    relation: Relation


class Column(Ref):
    """A column of a table; an expression, and the way to infer it from another table."""

    def __init__(self, table: "Table", name: str, type: BaseType):
        object.__setattr__(self, "table", table)
        super().__init__(name, type)

    def get_hidden_keys(self) -> list[str]:
        return list(self.table.relation(self.name).hidden)

    def get_strong_keys(self) -> list[str]:
        return list(self.table.relation(self.name).strong)

    def to_df(self) -> DataFrame:
        """This column alone, over its strong keys."""
        t = self.table
        if self.name in t.keys:
            return t.schema.domain(t.keys[self.name], self.name)
        own = t.relation(self.name)
        keys = {k: t.keys[k] for k in own.strong if k in t.keys}
        one = replace(t, keys=keys, shown=(*keys, self.name), marker=len(keys), order=())
        return one.to_df()

    def __str__(self) -> str:
        keys = " ".join(self.table.relation(self.name).strong) if self.name in self.table.values else self.name
        return f"[{keys} || {self.name}]"


@dataclass(frozen=True, eq=False)
class Table:
    schema: "Schema"
    keys: dict[str, Atom]
    hidden: dict[str, Atom]
    values: dict[str, Value]
    shown: tuple[str, ...]
    marker: int
    filters: tuple[Relation, ...] = ()
    order: tuple[str, ...] = ()

    @staticmethod
    def of(schema: "Schema", keys: dict[str, Atom]) -> "Table":
        return Table(schema, dict(keys), {}, {}, tuple(keys), len(keys))

    # columns

    @property
    def names(self) -> set[str]:
        return {*self.keys, *self.hidden, *self.values}

    def __getitem__(self, name: str) -> Column:
        if name in self.values:
            return Column(self, name, self.values[name].type)
        node = self.keys.get(name) or self.hidden.get(name)
        if node is None:
            raise KeyError(f"no column {name!r}; there are {sorted(self.names)}")
        return Column(self, name, self._type(node))

    def _type(self, node: Atom) -> BaseType:
        if isinstance(node, Concept):
            kinds = [x.type for x in self.schema.graph.equals(node) if isinstance(x, Attribute)]
            return kinds[0] if kinds else BaseType.OBJECT
        return node.type

    def _named(self, columns, kinds: str = "kv") -> list[str]:
        """Names of columns, which must exist once and be keys (k), values (v) or hidden keys (h)."""
        names = [c if isinstance(c, str) else c.name for c in ([columns] if isinstance(columns, (str, Ref)) else columns)]
        if len(set(names)) < len(names):
            raise ColumnError(f"columns are repeated: {names}")
        for name in names:
            kind = "k" if name in self.keys else "v" if name in self.values else "h" if name in self.hidden else ""
            if not kind:
                raise ColumnError(f"no column {name!r}; there are {sorted(self.names)}")
            if kind not in kinds:
                raise ColumnError(f"{name!r} is a {dict(k='key', v='value', h='hidden key')[kind]} column")
        return names

    def relation(self, name: str) -> Relation:
        if name not in self.values:
            raise ColumnError(f"{name!r} is no value column")
        return self.values[name].relation

    def domain(self, name: str) -> DataFrame:
        """Distinct values of a key."""
        return self.schema.domain(self.keys.get(name) or self.hidden[name], name)

    # inference

    def _walk(self, start: list[str], path: list["Step"], value: str, taken: set[str]) -> tuple[Relation, dict[str, Atom]]:
        """The relation of `value` along a path from columns of this table, and the hidden keys that its backward steps attach."""
        own = [self.relation(n) for n in start if n in self.values]
        strong = list(dict.fromkeys(k for r in own for k in r.strong))
        hidden = {k: self.hidden[k] for r in own for k in r.hidden}
        frame, source, members, df = None, {}, [], None  # as long as one frame has all columns, source tells where
        if own and all(r.base and r.base.scan == own[0].base.scan for r in own):
            base = own[0].base
            frame, members, needed = base.frame, list(base.members), list(base.needed)
            source = dict(base.columns) | {r.value: r.base.value for r in own}
        else:
            needed = []
            for r in own:
                df = natural(df, r.df)
        single = df is None
        bound = set(source) if single else set(df.columns)
        carried, attached = dict(hidden), {}
        cols = list(start)
        atoms = [self._node_of(n) for n in start]
        origin = dict(zip(start, atoms))

        def attach(atom: Atom) -> str:
            name = fresh(atom.name, {*taken, *carried, *attached})
            attached[name] = atom
            return name

        def joint() -> DataFrame | None:
            """The rows so far; from here on they are no longer one frame's."""
            nonlocal df, single
            if single and frame is not None:
                df = present(frame.select(*[col(c).alias(n) for n, c in source.items()]))
            single = False
            return df

        for step in path:
            there, here = parts(step.source), parts(step.target)
            if step.equal:
                for name, a, b in zip(cols, there, here):
                    if a != b and name not in bound and isinstance(a, Attribute) and name in self.keys:
                        members.append((name, a))
                continue
            places = None if step.cardinality.functional else sublist_places(there, here)
            if places is not None:
                at = dict(zip(places, cols))
                cols = [at[i] if i in at else attach(a) for i, a in enumerate(here)]
                origin |= {c: a for c, a in zip(cols, here) if c not in origin}
                continue
            places = sublist_places(here, there) if step.cardinality.functional else None
            if places is not None:
                for i, name in enumerate(cols):
                    if i not in places and name in attached and name not in bound:
                        df = natural(joint(), self.schema.domain(origin[name], name))
                        bound.add(name)
                cols = [cols[i] for i in places]
                continue
            data, from_columns, to_columns = self.schema.edge_data(step.source, step.target)
            new = [_temp() for _ in here] if step.cardinality.functional else [attach(a) for a in here]
            if len(set(cols)) < len(cols):
                raise ColumnError(f"columns are repeated on the way to {value!r}: {cols}")
            same = step.cardinality.functional and frame is data and all(source.get(c) == f for c, f in zip(cols, from_columns))
            if single and (same or frame is None):  # the frame's own row has it: no join
                frame = data
                source |= dict(zip(cols, from_columns)) | dict(zip(new, to_columns))
                needed += from_columns
            else:
                edge = present(data.select(*[col(f).alias(n) for f, n in zip([*from_columns, *to_columns], [*cols, *new])]))
                on = [c for c in cols if c in bound]
                left = joint()
                df = edge if left is None else left.join(edge, on, "inner") if on else left.crossJoin(edge)
            bound |= {*cols, *new}
            cols = new
            origin |= dict(zip(new, here))
        for name in [*cols, *attached]:
            if name not in bound:
                df = natural(joint(), self.schema.domain(origin[name], name))
                bound.add(name)
        strong += [n for n in start if n in self.keys and n in bound and n not in strong]
        hidden |= {n: self.hidden[n] for n in start if n in self.hidden}
        hidden |= attached
        if single:
            columns = tuple((k, source[k]) for k in (*strong, *hidden))
            extra = tuple(sorted(set(needed) - {c for _, c in columns}))
            base = Base(frame, columns, source[cols[0]], tuple(members), extra)
            return _read(self.schema, [Relation(None, tuple(strong), tuple(hidden), value, base)], True), attached
        df = df.select(*map(quoted, (*strong, *hidden)), col(cols[0]).alias(value))
        for name, atom in members:
            df = df.join(self.schema.domain(atom, name), [name], "left_semi").select(*map(quoted, (*strong, *hidden, value)))
        return Relation(df, tuple(strong), tuple(hidden), value), attached

    def _node_of(self, name: str) -> Atom:
        return self.keys.get(name) or self.hidden.get(name) or self.values[name].node

    def _with_value(self, name: str, value: Value, attached: dict[str, Atom]) -> "Table":
        return replace(self, values={**self.values, name: value}, hidden={**self.hidden, **attached}, shown=(*self.shown, name))

    def infer(self, from_columns, to, via: list[Atom] | None = None, with_name: str | None = None) -> "Table":
        """Add a value: a node, along the unique shortest path from the given columns; or a column of another table.

        From no columns at all, the node's whole domain is one list.
        """
        start = self._named(from_columns, "kvh")
        if isinstance(to, Column):
            return self._splice(start, to, with_name)
        name = fresh(with_name or to.name, self.names)
        if not start:
            key = fresh(name, {*self.names, name})
            df = self.schema.domain(to, key).select(quoted(key), col(key).alias(name))
            return self._with_value(name, Value(to, self._type(to), Relation(df, (), (key,), name)), {key: to})
        path = self.schema.graph.path(product([self._node_of(n) for n in start]), to, via)
        relation, attached = self._walk(start, path, name, self.names | {name})
        return self._with_value(name, Value(to, self._type(to), relation), attached)

    def _splice(self, start: list[str], column: Column, with_name: str | None) -> "Table":
        other = column.table
        own = other.relation(column.name)
        if len(start) != len(own.strong):
            raise ColumnError(f"{column.name!r} has the keys {list(own.strong)}; given: {start}")
        name = fresh(with_name or column.name, self.names)
        taken = self.names | {name}
        names, attached = {column.name: name}, {}
        for h in own.hidden:
            new = fresh(h, {*taken, *attached})
            names[h], attached[new] = new, other.hidden[h]
        relation = replace(self._filtered(other, own), seen=0)
        stand = {k: _temp() for k in own.strong}
        relation = relation.renamed(names | stand)
        for key, mine in zip(own.strong, start):
            there, here = other.keys[key], self._node_of(mine)
            path = self.schema.graph.path(here, there) if here != there else []
            if not path and mine in self.keys:
                relation = relation.renamed({stand[key]: mine})
                continue
            bridge, more = self._walk([mine], path, stand[key], taken | set(attached))
            attached |= more
            relation = _through(bridge, relation, stand[key])
        strong = tuple(dict.fromkeys(relation.strong))
        value = other.values[column.name]
        return self._with_value(name, Value(value.node, value.type, replace(relation, strong=strong)), attached)

    @staticmethod
    def _filtered(table: "Table", relation: Relation) -> Relation:
        for f in table.filters[relation.seen :]:
            relation = relation.semi(f.df, [k for k in f.keys if k in relation.keys])
        return replace(relation, seen=len(table.filters))

    def compose(self, new_keys, old_key, via: list[Atom] | None = None) -> "Table":
        """Replace a key by others that it can be inferred from; every column over it is re-keyed.

        new_keys: nodes, or {name: node}.
        """
        (old,) = self._named(old_key, "k")
        rest = self.names - {old}
        given = new_keys.items() if isinstance(new_keys, dict) else [(n.name, n) for n in ([new_keys] if isinstance(new_keys, (Attribute, Concept)) else new_keys)]
        keys: dict[str, Atom] = {}
        for name, node in given:
            keys[fresh(name, {*rest, *keys})] = node
        base = Table.of(self.schema, keys)
        path = self.schema.graph.path(product(list(keys.values())), self.keys[old], via)
        stand = _temp()
        bridge, attached = base._walk(list(keys), path, stand, {*rest, *keys})
        values = {}
        for name, v in self.values.items():
            r = v.relation
            values[name] = replace(v, relation=replace(_through(bridge, r.renamed({old: stand}), stand), seen=r.seen)) if old in r.strong else v
        filters = tuple(_through(bridge, f.renamed({old: stand}), stand) if old in f.strong else f for f in self.filters)
        at = self.shown.index(old)
        order = [*self.keys]
        i = order.index(old)
        every = {**self.keys, **keys}
        order[i : i + 1] = list(keys)
        return replace(
            self, keys={k: every[k] for k in order}, values=values, hidden={**self.hidden, **attached}, shown=(*self.shown[:at], *keys, *self.shown[at + 1 :]), marker=self.marker + len(keys) - 1,
            filters=filters, order=tuple(c for c in self.order if c != old),
        )

    # derived columns

    def mutate(self, **expressions: Expr) -> "Table":
        """Derive columns; later ones do not see earlier ones."""
        t = self
        for name, expr in expressions.items():
            t = t.deduce(expr, name)
        return t

    def deduce(self, expr: Expr, with_name: str) -> "Table":
        name = fresh(with_name, self.names)
        expr = wrap(expr)
        relation = replace(self._evaluate(expr, name), seen=len(self.filters))
        node = Attribute(name, expr.type)
        self.schema._domains[node] = (relation.df, name)
        return self._with_value(name, Value(node, expr.type, relation), {})

    assign = deduce

    def _evaluate(self, expr: Expr, name: str) -> Relation:
        """The relation of an expression. Operands meet on all keys they share, hidden ones too; where an operand has no value, neither has the result."""
        if isinstance(expr, Ref) and expr.name in self.values:
            return self._filtered(self, self.relation(expr.name)).renamed({expr.name: name})
        found = leaves(expr)
        refs = {x.name for x in found if isinstance(x, Ref)}
        columns: dict[int, str] = {}
        df, strong, hidden = None, [], []
        windows: dict[int, Aggregate] = {}

        def add(r: Relation) -> None:
            nonlocal df, strong, hidden
            df = natural(df, r.df)
            strong += [k for k in r.strong if k not in strong]
            hidden += [k for k in r.hidden if k not in hidden]

        for r in _joint(self.schema, [self._filtered(self, self.relation(n)) for n in sorted(refs & set(self.values))]):
            add(r)
        single = df is not None
        for x in found:
            if isinstance(x, Ref):
                columns[id(x)] = x.name
                continue
            columns[id(x)] = _temp()
            if isinstance(x, Aggregate) and single and {y.name for y in leaves(x.of) if isinstance(y, Ref)} == refs & set(self.values) == {y.name for y in _all_refs(x.of)}:
                windows[id(x)] = x  # over the very rows at hand: a window, not a group and a join
                continue
            add(self._aggregate(x, columns[id(x)]) if isinstance(x, Aggregate) else self._extend(x, columns[id(x)]))
        for ref in refs - set(self.values):
            if df is None or ref not in df.columns:
                df = natural(df, self.domain(ref))
            if ref in self.keys and ref not in strong:
                strong.append(ref)
            if ref in self.hidden and ref not in hidden:
                hidden.append(ref)
        if df is None:
            df = self.schema.spark.range(1).select()
        for key, x in windows.items():
            inner = to_spark(x.of, lambda y: col(columns[id(y)]) if id(y) in columns else col(y.name))
            over = Window.partitionBy(*map(quoted, [k for k in strong if k in self.keys])) if strong else Window.partitionBy(F.lit(0))
            df = df.withColumn(columns[key], _fold(x, inner, hidden).over(over))
        value = to_spark(expr, lambda y: col(columns[id(y)]))
        df = df.select(*map(quoted, (*strong, *hidden)), value.alias(name)).filter(col(name).isNotNull())
        return Relation(df, tuple(strong), tuple(hidden), name)

    def _aggregate(self, x: Aggregate, name: str) -> Relation:
        inner = self._evaluate(x.of, _temp())
        agg = _fold(x, col(inner.value), list(inner.hidden)).alias(name)
        df = inner.df.groupBy(*map(quoted, inner.strong)).agg(agg) if inner.strong else inner.df.agg(agg)
        return Relation(df.filter(col(name).isNotNull()), inner.strong, (), name)

    def _extend(self, x: Extend, name: str) -> Relation:
        inner = self._evaluate(x.of, name)
        df = None
        for key in inner.keys:
            df = natural(df, self.domain(key))
        df = df.join(inner.df, list(inner.keys), "left") if inner.keys else inner.df
        if isinstance(x.fill, Literal):
            fill = F.lit(x.fill.value)
        else:
            own = self._evaluate(x.fill, _temp())
            on = [k for k in own.keys if k in df.columns]
            df = df.join(own.df, on, "left") if on else df.crossJoin(own.df)
            fill = col(own.value)
        value = col(name)
        if x.type == BaseType.FLOAT:
            value, fill = value.cast("double"), fill.cast("double")
        return Relation(df.select(*map(quoted, inner.keys), F.coalesce(value, fill).alias(name)).filter(col(name).isNotNull()), inner.strong, inner.hidden, name)

    def mask(self, column, condition: Expr, name: str) -> "Table":
        """A column's values where a condition holds, as a new column."""
        (own,) = self._named(column)
        return self.deduce(self[own].mask(condition), name)

    # reshaping

    def displayed(self, columns, marker: int) -> "Table":
        """The same table with these columns in this order, `marker` of them on the left. Keys stay on the left, all of them."""
        names = self._named(columns)
        if not set(self.keys) <= set(names[:marker]):
            raise ColumnError(f"the keys {sorted(self.keys)} have to be left of the marker")
        return replace(self, shown=tuple(names), marker=marker)

    def _map(self, change) -> dict[str, Value]:
        return {n: replace(v, relation=change(v.relation)) for n, v in self.values.items()}

    def hide(self, column) -> "Table":
        """Hide a key, so that values over it become lists; or take a value out of the display."""
        (name,) = self._named(column)
        at = self.shown.index(name) if name in self.shown else -1
        shown = tuple(c for c in self.shown if c != name)
        marker = self.marker - (0 <= at < self.marker)
        if name in self.values:
            return replace(self, shown=shown, marker=marker)
        keys = dict(self.keys)
        hidden = {**self.hidden, name: keys.pop(name)}
        return replace(self, keys=keys, hidden=hidden, values=self._map(lambda r: r.moved(name, True)), shown=shown, marker=marker, filters=tuple(f.moved(name, True) for f in self.filters))

    forget = hide

    def show(self, column) -> "Table":
        """Make a hidden key a key again, the last left of the marker; lists over it unnest. A hidden value is displayed there."""
        (name,) = self._named(column, "hv")
        if name in self.shown:
            raise ColumnError(f"{name!r} is displayed already")
        shown = (*self.shown[: self.marker], name, *self.shown[self.marker :])
        if name in self.values:
            return replace(self, shown=shown, marker=self.marker + 1)
        hidden = dict(self.hidden)
        keys = {**self.keys, name: hidden.pop(name)}
        return replace(self, keys=keys, hidden=hidden, values=self._map(lambda r: r.moved(name, False)), shown=shown, marker=self.marker + 1, filters=tuple(f.moved(name, False) for f in self.filters))

    def rename(self, column, new_name: str) -> "Table":
        (old,) = self._named(column, "kvh")
        name = fresh(new_name, self.names - {old})
        new = lambda c: name if c == old else c
        values = {new(n): replace(v, relation=v.relation.renamed({old: name})) for n, v in self.values.items()}
        return replace(
            self, keys={new(k): n for k, n in self.keys.items()}, hidden={new(k): n for k, n in self.hidden.items()}, values=values,
            shown=tuple(map(new, self.shown)), filters=tuple(f.renamed({old: name}) for f in self.filters), order=tuple(map(new, self.order)),
        )

    def swap(self, left: str, right: str) -> "Table":
        """Exchange two neighbours of the display."""
        i, j = (self.shown.index(n) for n in self._named([left, right]))
        if i + 1 != j:
            raise ColumnError(f"{left!r} and {right!r} are not neighbours in {list(self.shown)}")
        shown = list(self.shown)
        shown[i], shown[j] = shown[j], shown[i]
        return replace(self, shown=tuple(shown))

    def shift_right(self) -> "Table":
        """Move the first value left of the marker, where it is a row key of the display."""
        if self.marker >= len(self.shown):
            raise ColumnError("nothing is right of the marker")
        return replace(self, marker=self.marker + 1)

    def shift_left(self) -> "Table":
        """Move the last column left of the marker to its right. A key is hidden, and its domain shown as a list."""
        if self.marker <= 1:
            raise ColumnError("one column has to stay left of the marker")
        name = self.shown[self.marker - 1]
        if name in self.values:
            return replace(self, marker=self.marker - 1)
        node = self.keys[name]
        key = fresh(name, self.names)
        t = self.rename(name, key).hide(key)
        df = self.schema.domain(node, key).select(quoted(key), col(key).alias(name))
        value = Value(node, self._type(node), Relation(df, (), (key,), name))
        return replace(t, values={**t.values, name: value}, shown=(*t.shown[: t.marker], name, *t.shown[t.marker :]))

    def equate(self, first, second) -> "Table":
        """Keep the first of two keys: values over both stay where both are equal, values over the second go over the first."""
        a, b = self._named([first, second], "k")

        def change(r: Relation) -> Relation:
            if b not in r.strong:
                return r
            if a not in r.strong:
                return r.renamed({b: a})
            strong = tuple(k for k in r.strong if k != b)
            return Relation(r.df.filter(col(a) == col(b)).select(*map(quoted, (*strong, *r.hidden, r.value))), strong, r.hidden, r.value, seen=r.seen)

        at = self.shown.index(b)
        keys = {k: n for k, n in self.keys.items() if k != b}
        filters = tuple(change(f) for f in self.filters)
        return replace(self, keys=keys, values=self._map(change), shown=tuple(c for c in self.shown if c != b), marker=self.marker - (at < self.marker), filters=filters, order=tuple(c for c in self.order if c != b))

    def _rekey(self, keys: list[str], vals: list[str]) -> tuple[dict[str, Value], dict[str, Atom]]:
        """Values when vals become keys in place of keys, which become values; and the hidden keys that remember them."""
        copies = {}
        for k in keys:
            copies[k] = fresh(k, {*self.names, *copies.values()})
        out: dict[str, Value] = {}

        def joined(over: set[str], more: Relation | None = None) -> tuple[DataFrame, list[str], list[str], list[str]] | None:
            """Natural join of the inverted values that depend on any of these keys, and one more relation."""
            mine = {v: self._filtered(self, self.relation(v)) for v in vals}
            own = [v for v in vals if over & set(mine[v].strong)]
            if not own:
                return None
            df, every = None, [*(mine[v] for v in own), *([more] if more else [])]
            for r in _joint(self.schema, every):
                df = natural(df, r.df)
            strong, hidden = (list(dict.fromkeys(k for r in every for k in getattr(r, kind))) for kind in ("strong", "hidden"))
            return df, strong, hidden, own

        def placed(df: DataFrame, strong: list[str], hidden: list[str], own: list[str], name: str, value) -> Relation:
            left = [s for s in strong if s not in keys]
            gone = [s for s in strong if s in keys]
            new_strong = [*own, *(s for s in left if s not in own)]
            new_hidden = [*(copies[k] for k in gone), *hidden]
            rows = df.select(*map(quoted, new_strong), *[col(k).alias(copies[k]) for k in gone], *map(quoted, hidden), value.alias(name))
            return Relation(rows, tuple(new_strong), tuple(new_hidden), name)

        for k in keys:
            found = joined({k})
            if found is None:
                raise ColumnError(f"none of {vals} depends on {k!r}")
            node = self.keys[k]
            out[k] = Value(node, self._type(node), placed(*found, k, col(k)))
        for name, v in self.values.items():
            if name in vals:
                continue
            r = self._filtered(self, v.relation)
            found = joined(set(r.strong) & set(keys), r)
            if found is None:
                out[name] = replace(v, relation=replace(r, seen=0))
                continue
            out[name] = replace(v, relation=placed(*found, name, col(name)))
        return out, {copies[k]: self.keys[k] for k in keys}

    def invert(self, keys, vals) -> "Table":
        """Values become keys; the keys become list values, and columns over them follow."""
        keys, vals = self._named(keys, "k"), self._named(vals, "v")
        values, attached = self._rekey(keys, vals)
        order = [*self.keys]
        at = order.index(keys[0])
        rest = [k for k in order if k not in keys]
        at = min(at, len(rest))
        nodes = {**{k: self.keys[k] for k in rest}, **{v: self.values[v].node for v in vals}}
        order = [*rest[:at], *vals, *rest[at:]]
        place = self.shown.index(keys[0])
        left = sum(self.shown.index(k) < self.marker for k in keys)
        others = [c for c in self.shown if c not in keys and c not in vals]
        place = min(place, len(others))
        over = sum(v in self.shown[: self.marker] for v in vals)
        shown = (*others[:place], *vals, *others[place:], *keys)
        return replace(self, keys={k: nodes[k] for k in order}, values=values, hidden={**self.hidden, **attached}, shown=shown, marker=self.marker + len(vals) - left - over, filters=(), order=())

    def group_by(self, columns) -> "Table":
        """A table keyed by these columns: the other keys of its values become list values, and further columns follow."""
        columns = self._named(columns)
        vals = [c for c in columns if c in self.values]
        kept = [c for c in columns if c in self.keys]
        needed = {s for v in vals for s in self.relation(v).strong} - set(kept)
        gone = [c for c in self.shown if c in needed]
        values, attached = self._rekey(gone, vals)
        nodes = {c: self.keys.get(c) or self.values[c].node for c in columns}
        weak = [k for k in self.keys if k not in kept and k not in gone]
        rest = [c for c in self.shown if c not in columns and c not in gone and c in values]
        t = replace(self, keys={**nodes, **{k: self.keys[k] for k in weak}}, values=values, hidden={**self.hidden, **attached}, shown=(*columns, *weak, *gone, *rest), marker=len(columns) + len(weak), filters=(), order=())
        for k in weak:
            t = t.hide(k)
        return t

    # rows

    def filter(self, by) -> "Table":
        """Keep rows where a column has a value, or a condition holds. Of lists, elements are dropped; keys left with none go."""
        if isinstance(by, Expr) and not isinstance(by, Ref):
            condition = self._evaluate(wrap(by)._need(BaseType.BOOL), _temp())
            condition = replace(condition, df=condition.df.filter(col(condition.value)))
        else:
            (name,) = self._named(by)
            if name in self.keys:
                return self
            condition = self.relation(name)
        t = replace(self, filters=(*self.filters, condition))
        return replace(t, values=t._map(lambda r: self._filtered(t, r)))

    def sort(self, columns) -> "Table":
        """Ascending order of the display, nulls last."""
        return replace(self, order=tuple(self._named(columns)))

    def semi_join(self, other: DataFrame, on: list[str], anti: bool = False) -> DataFrame:
        """Displayed rows with (or without) a match in other."""
        return self.to_df().join(other, on, "left_anti" if anti else "left_semi")

    def limit(self, n: int) -> DataFrame:
        return self.to_df().limit(n)

    # display

    def to_df(self) -> DataFrame:
        from .display import compiled

        return compiled(self)

    def hidden_count(self) -> int:
        """How many combinations of keys are not shown: an action."""
        from .display import hidden_count

        return hidden_count(self)

    @property
    def header(self) -> str:
        return f"[{' '.join(self.shown[: self.marker])} || {' '.join(self.shown[self.marker :])}]"

    def __str__(self) -> str:
        rows = self.to_df().limit(21).toPandas()
        more = "\n..." if len(rows) > 20 else ""
        n = self.hidden_count()
        return f"{self.header}\n{rows.head(20).to_string(index=False)}{more}\n" + (f"{n} keys hidden\n" if n else "")


def _through(bridge: Relation, relation: Relation, key: str) -> Relation:
    """relation over the bridge's keys instead of `key`, which is the bridge's value."""
    strong = (*bridge.strong, *(k for k in relation.strong if k != key and k not in bridge.strong))
    hidden = (*bridge.hidden, *(h for h in relation.hidden if h not in bridge.hidden))
    on = [c for c in bridge.df.columns if c in relation.df.columns]
    df = bridge.df.join(relation.df, on).select(*map(quoted, (*strong, *hidden, relation.value)))
    return Relation(df, strong, hidden, relation.value)


def _read(schema: "Schema", group: list[Relation], strict: bool) -> Relation:
    """Values that one scan has, read off together; strict: rows with all of them, else with any."""
    base = group[0].base
    rows = present(base.frame, [*dict.fromkeys((*(c for _, c in base.columns), *base.needed))])
    rows = present(rows, list(dict.fromkeys(r.base.value for r in group)), some=not strict)
    df = rows.select(*[col(c).alias(k) for k, c in base.columns], *[col(r.base.value).alias(r.value) for r in group])
    for name, atom in base.members:
        df = df.join(schema.domain(atom, name), [name], "left_semi").select(*map(quoted, df.columns))
    return replace(group[0], df=df)


def _joint(schema: "Schema", relations: list[Relation]) -> list[Relation]:
    """The relations, those of one scan united to one with all their values."""
    out, groups = [], {}
    for r in relations:
        groups.setdefault((r.base.scan, frozenset(r.strong)) if r.base else len(groups), []).append(r)
    for group in groups.values():
        out.append(_read(schema, group, True) if len(group) > 1 else group[0])
    return out


def _all_refs(expr: Expr) -> list[Ref]:
    out = []
    for x in leaves(expr):
        out += [x] if isinstance(x, Ref) else [*_all_refs(x.of)]
    return out


def _fold(x: Aggregate, value, hidden: list[str]):
    if x.function is not None:
        return x.function(value)
    if x.op == "pop":
        return F.min_by(value, F.struct(*map(quoted, hidden))) if hidden else F.min(value)
    if x.op == "count":
        return F.when(F.count(value) > 0, F.count(value).cast("double"))
    return {"sum": lambda v: F.sum(v.cast("double")), "avg": lambda v: F.avg(v.cast("double")), "max": F.max, "min": F.min, "any": F.bool_or, "all": F.bool_and}[x.op](value)
