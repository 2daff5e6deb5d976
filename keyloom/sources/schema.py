"""The catalog: registered datasets, the classes that join them, and tables over them."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from ..errors import ColumnError, DuplicateKeyError, EdgeMissingError, NotANodeError
from ..plans.graph import Graph
from ..plans.nodes import Atom, Attribute, Cardinality, Concept, Node, parts, product
from ..plans.relation import col, present, quoted
from ..types import base_type

if TYPE_CHECKING:
    from ..operators.table import Table


class Dataset(dict):
    """Nodes of a registered dataset by column name."""

    def __init__(self, nodes: dict[str, Attribute], keys: list[str]):
        super().__init__(nodes)
        self.keys_ = keys


class Schema:
    """Datasets are registered with their keys; blend() says which columns mean the same; get() begins a table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graph = Graph()
        self._edges: dict[tuple[Node, Node], tuple[DataFrame, list[str], list[str]]] = {}
        self._domains: dict[Atom, tuple[DataFrame, str]] = {}

    # sources

    def register(self, df, keys: str | list[str], check: bool = True) -> Dataset:
        """Register a Spark (or pandas) frame whose `keys` determine the other columns.

        With check, one aggregation makes sure of that and names offending keys.
        Rows with a null key or a null value are no part of a dependency.
        """
        if not isinstance(df, DataFrame):
            df = self._from_pandas(df, keys)
        keys = [keys] if isinstance(keys, str) else list(keys)
        missing = [k for k in keys if k not in df.columns]
        if missing or not keys:
            raise ColumnError(f"keys {missing or 'must be given'}: not columns of {df.columns}")
        if check:
            twice = df.groupBy(*map(quoted, keys)).count().filter("count > 1").select(*map(quoted, keys)).limit(6).collect()
            if twice:
                shown = ", ".join(str(tuple(r)) for r in twice[:5])
                raise DuplicateKeyError(f"{keys} occur more than once: {shown}{', ...' if len(twice) > 5 else ''}")
        nodes = {f.name: Attribute(f.name, base_type(f.dataType)) for f in df.schema.fields}
        for name, node in nodes.items():
            self.graph.add_node(node)
            self._domains[node] = (df, name)
        key = product([nodes[k] for k in keys])
        for name, node in nodes.items():
            if name not in keys or len(keys) > 1:
                self._edge(key, node, Cardinality.MANY_TO_ONE, df, keys, [name])
        return Dataset(nodes, keys)

    insert_dataframe = register

    def _from_pandas(self, frame, keys: str | list[str]) -> DataFrame:
        names = [n for n in frame.index.names if n is not None]
        frame = frame.reset_index() if names else frame
        return self.spark.createDataFrame(frame)

    def register_path(self, path: str, keys: str | list[str], format: str = "parquet", check: bool = True, **options) -> Dataset:
        """Register a file source that Spark reads: parquet, csv, json, orc, ..."""
        return self.register(self.spark.read.format(format).options(**options).load(path), keys, check)

    def register_table(self, name: str, keys: str | list[str], check: bool = True) -> Dataset:
        return self.register(self.spark.table(name), keys, check)

    # catalog

    def add_node(self, node: Attribute) -> Attribute:
        self.graph.add_node(node)
        return node

    def add_edge(self, source: Node, target: Node, cardinality: Cardinality, df: DataFrame, source_columns: list[str], target_columns: list[str]) -> None:
        """A dependency with data of its own: columns of df in the order of the nodes' parts."""
        self._edge(source, target, cardinality, df, source_columns, target_columns)
        for node, name in zip((*parts(source), *parts(target)), (*source_columns, *target_columns)):
            self._domains.setdefault(node, (df, name))

    def _edge(self, source: Node, target: Node, cardinality: Cardinality, df: DataFrame, source_columns: list[str], target_columns: list[str]) -> None:
        self.graph.add_edge(source, target, cardinality)
        self._edges[source, target] = (df, source_columns, target_columns)
        self._edges[target, source] = (df, target_columns, source_columns)

    def create_class(self, name: str) -> Concept:
        concept = Concept(name)
        self.graph.add_concept(concept)
        return concept

    def blend(self, a: Atom, b: Atom, under: Concept | None = None) -> None:
        """Say that a and b mean the same; `under` names the class they are of."""
        self.graph.blend(a, b, under)

    def are_nodes_equal(self, a: Node, b: Node) -> bool:
        return self.graph.are_equal(a, b)

    def get(self, **keys: Atom) -> "Table":
        """A table of these keys. Its key space is their product, but only keys of values are ever shown."""
        from ..operators.table import Table

        for name, node in keys.items():
            if not isinstance(node, (Attribute, Concept)):
                raise NotANodeError(f"{name}: {node!r} is neither a column node nor a class")
            self.graph.check(node)
        return Table.of(self, keys)

    # data

    def domain(self, atom: Atom, name: str) -> DataFrame:
        """Distinct values of a node; of a class, those of all its members."""
        if isinstance(atom, Attribute):
            df, column = self._domains[atom]
            return present(df.select(col(column).alias(name))).distinct()
        members = [x for x in self.graph.equals(atom) if isinstance(x, Attribute)]
        if not members:
            raise ColumnError(f"class {atom} has no members")
        out = None
        for member in members:
            df, column = self._domains[member]
            own = df.select(col(column).alias(name))
            out = own if out is None else out.union(own)
        return present(out).distinct()

    def edge_data(self, source: Node, target: Node) -> tuple[DataFrame, list[str], list[str]]:
        """(frame, source columns, target columns) of a dependency."""
        if (source, target) not in self._edges:
            raise EdgeMissingError(f"no data for {source} -> {target}")
        return self._edges[source, target]

    def __str__(self) -> str:
        return str(self.graph)

