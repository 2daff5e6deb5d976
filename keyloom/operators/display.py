"""A table as one DataFrame."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.relation import Relation, col, natural, quoted

if TYPE_CHECKING:
    from .table import Table


def _listed(group: list[Relation], df: DataFrame, rows_over: set[str]) -> tuple[DataFrame, tuple[str, ...], bool]:
    """(rows, keys, whether values are lists) for values of one frame: one row for each combination of the keys that rows have."""
    r, values = group[0], [x.value for x in group]
    keys = (*r.strong, *(h for h in r.hidden if h in rows_over))
    inner = [h for h in r.hidden if h not in rows_over]
    if not inner:
        return df.select(*map(quoted, (*keys, *values))), keys, False
    item = F.struct(*[col(h).alias(f"h{i}") for i, h in enumerate(inner)], *[col(v).alias(f"v{i}") for i, v in enumerate(values)])
    grouped = df.groupBy(*map(quoted, keys)).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    if not keys:
        grouped = grouped.filter(F.size("__items") > 0)

    def values_of(i: int):
        there = F.filter("__items", lambda x: x[f"v{i}"].isNotNull()) if len(values) > 1 else F.col("__items")
        return F.transform(there, lambda x: x[f"v{i}"])

    return grouped.select(*map(quoted, keys), *[values_of(i).alias(v) for i, v in enumerate(values)]), keys, True


def compiled(table: "Table") -> DataFrame:
    """The displayed columns.

    Values over the same keys meet in outer joins on those keys. Keys that a
    value lacks are filled in from their domains, and only those: the product of
    all domains is never built. Rows without any right-hand value are not shown.
    """
    from .table import _read

    left, right = table.shown[: table.marker], table.shown[table.marker :]
    left_values = [c for c in left if c in table.values]
    keys = [c for c in left if c in table.keys]
    if not right:
        fields = [T.StructField(c, _kind(table, c)) for c in left]
        return table.schema.spark.createDataFrame([], T.StructType(fields))
    above, row_hidden = None, []
    for c in left_values:
        r = table.relation(c)
        above = natural(above, r.df)
        row_hidden += [h for h in r.hidden if h not in row_hidden]
    rows_over = {*keys, *row_hidden}

    groups: dict[frozenset[str], list[DataFrame]] = {}
    scans: dict[object, list[Relation]] = {}
    lists: list[str] = []
    for c in right:
        r = table.relation(c)
        scans.setdefault((r.base.scan, frozenset(r.strong)) if r.base else len(scans), []).append(r)
    for group in scans.values():
        rows = _read(table.schema, group, False).df if len(group) > 1 else group[0].df
        df, own, is_list = _listed(group, rows, rows_over)
        lists += [r.value for r in group] if is_list else []
        groups.setdefault(frozenset(own), []).append(df)
    merged: list[tuple[list[str], DataFrame]] = []
    for own, frames in groups.items():
        on = sorted(own)
        df = frames[0]
        for other in frames[1:]:
            df = df.join(other, on, "full") if on else df.crossJoin(other)
        merged.append((on, df))

    wanted = [*keys, *row_hidden, *left_values]
    if len(merged) == 1 and above is None and set(merged[0][0]) == rows_over:
        rows = merged[0][1]
    else:
        skeleton = None
        for on, df in merged:
            own = df.select(*map(quoted, on)).distinct() if on else None
            part = natural(above, own) if own is not None and above is not None else own if own is not None else above
            for k in keys:
                if part is None or k not in part.columns:
                    part = natural(part, table.domain(k))
            if part is None:
                part = df.select(F.lit(1).alias("__one")).limit(1)
            part = part.select(*map(quoted, wanted)) if wanted else part
            skeleton = part if skeleton is None else skeleton.union(part)
        rows = skeleton.distinct() if len(merged) > 1 or above is not None else skeleton
        for on, df in merged:
            rows = rows.join(df, on, "left") if on else rows.join(df, F.lit(True), "left")
    for f in table.filters:
        on = [k for k in f.keys if k in rows_over]
        if on:
            rows = rows.join(f.df.select(*map(quoted, on)).distinct(), on, "left_semi")
    out = rows.select(*[F.coalesce(col(c), F.array().cast(dict(rows.dtypes)[c])).alias(c) if c in lists else col(c) for c in table.shown])
    if row_hidden or left_values:
        out = out.distinct()
    if table.order:
        out = out.orderBy(*[F.asc_nulls_last(quoted(c)) for c in table.order])
    return out


def _kind(table: "Table", name: str) -> T.DataType:
    df = table.relation(name).df if name in table.values else table.domain(name)
    return df.schema[name].dataType


def hidden_count(table: "Table") -> int:
    """Combinations of the domains left of the marker, hidden keys of values there included, less the rows shown."""
    total, names = 1, []
    for c in table.shown[: table.marker]:
        if c in table.keys:
            names.append(c)
            continue
        total *= table.schema.domain(table.values[c].node, c).count()
        names += [h for h in table.relation(c).hidden if h not in names]
    for n in names:
        total *= table.domain(n).count()
    return total - (table.to_df().count() if len(table.shown) > table.marker else 0)
