"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree, domain by language by source. A leaf offers at most its
tokens times the allowed epochs; what it is short of goes to its siblings in
proportion to their weights, and only what they cannot take goes up to the
ancestor's siblings. Each leaf then takes the prefix of its tokens, epoch after
epoch, in an order seeded by the epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

#: A leaf's rows are dealt by their order in an epoch into 2 ** BUCKET_BITS parts; a cut falls into one of them, which alone is sorted.
BUCKET_BITS = 10
DEFAULT_WEIGHT = 1.0


@dataclass(frozen=True)
class Mix:
    """Target weights by path prefix, the token budget as a share of the input (or in tokens), and how often a row may be taken."""

    weights: dict[tuple[str | None, ...], float]
    share: float = 1.0
    tokens: int | None = None
    epochs: int = 1
    seed: int = 1


def _dealt(budget: float, offers: dict[tuple, float], mix: Mix) -> dict[tuple, float]:
    """Deal budget among siblings by weight; one whose offer is less than its due gives the rest to the others.

    The siblings that are short are those with the least offer for their weight.
    """
    weight = {c: max(0.0, mix.weights.get(c, DEFAULT_WEIGHT)) for c in offers}
    total, due = sum(weight.values()), dict.fromkeys(offers, 0.0)
    for c in sorted((c for c in offers if weight[c] > 0), key=lambda c: offers[c] / weight[c]):
        due[c] = min(offers[c], budget * weight[c] / total)
        budget, total = budget - due[c], total - weight[c]
    return due


def budgets(offers: dict[tuple, int], mix: Mix) -> dict[tuple, int]:
    """Tokens that each leaf is to give, of what it has (tokens by path). The tree is built once, and gone through once."""
    if not offers:
        return {}
    children: dict[tuple, dict[tuple, float]] = {}
    sums: dict[tuple, float] = dict.fromkeys(offers, 0.0)
    for leaf, n in offers.items():
        sums[leaf] = float(n * mix.epochs)
    level = dict(sums)
    for _ in range(len(next(iter(offers)))):
        above: dict[tuple, float] = {}
        for path, n in level.items():
            children.setdefault(path[:-1], {})[path] = n
            above[path[:-1]] = above.get(path[:-1], 0.0) + n
        level = above
    total = mix.tokens if mix.tokens is not None else mix.share * sum(offers.values())
    todo, out = [((), min(float(total), level[()]))], {}
    while todo:
        path, budget = todo.pop()
        if path in children:
            todo.extend(_dealt(budget, children[path], mix).items())
        else:
            out[path] = int(round(budget))
    return out


def select(docs: DataFrame, mix: Mix, path: list[Column], tokens: Column, key: str = "doc_id") -> DataFrame:
    """docs with `epoch` (from 0): the rows that make up each leaf's budget, a row once for each epoch that takes it.

    A leaf's prefix ends with the row that reaches its budget. Null path parts
    are a branch of their own; rows of no tokens come along where they fall
    within the prefix, and a leaf without tokens gives nothing; equal rows take
    part each by itself, and a table without rows gives none. Rows are ordered in an
    epoch by a seeded hash of key and tokens, then by key, then by a hash of all their
    columns. A column `epoch` of docs is replaced. The tree of leaves (not of rows) is
    budgeted on the driver.

    No task holds a leaf: rows fall by their order into parts of the leaf, whose
    sums tell in which part the cut falls. Parts before it are taken whole, and
    that part alone is sorted.
    """
    spark = docs.sparkSession
    docs = docs.drop("epoch")
    names = docs.columns
    depth = len(path)
    rows = docs.withColumns({f"_kl_p{i}": p for i, p in enumerate(path)} | {"_kl_n": F.coalesce(tokens.cast("long"), F.lit(0))})
    parts = [f"_kl_p{i}" for i in range(depth)]
    sums = rows.groupBy(*parts).agg(F.sum("_kl_n").alias("n")).toArrow().to_pylist()
    offers = {tuple(r[p] for p in parts): r["n"] for r in sums}
    todo = []
    for leaf, budget in budgets(offers, mix).items():
        n = offers[leaf]
        whole = min(mix.epochs, budget // n) if n else 0
        for e in range(mix.epochs):
            rest = n if e < whole else budget - whole * n if e == whole else 0
            if rest > 0:
                todo.append((*leaf, e, int(rest), None if rest >= n else -1, 0))
    kinds = ", ".join(f"{p} {dict(rows.dtypes)[p]}" for p in parts)
    schema = f"{kinds}, epoch int, _kl_budget long, _kl_cut long, _kl_before long"
    leaf = [*parts, "epoch"]

    def ordered(plan: list[tuple]) -> DataFrame:
        """Each row once for each epoch of its leaf's plan, with its place in that epoch's order."""
        match = [F.col(f"r.{p}").eqNullSafe(F.col(f"b.{p}")) for p in parts]
        out = rows.alias("r").join(C.local_table(spark, plan, schema).alias("b"), match)
        out = out.select(*[F.col(f"r.`{c}`") for c in names], *[F.col(f"r.{p}") for p in parts], "_kl_n", "epoch", "_kl_budget", "_kl_cut", "_kl_before")
        out = out.withColumn("_kl_o", F.xxhash64(F.lit(mix.seed), F.col("epoch"), F.col(key), F.col("_kl_n")))
        return out.withColumn("_kl_b", F.shiftrightunsigned("_kl_o", 64 - BUCKET_BITS))

    sizes = ordered([t for t in todo if t[-2] is not None]).groupBy(*leaf, "_kl_b", "_kl_budget").agg(F.sum("_kl_n").alias("s"))
    upto = Window.partitionBy(*leaf).orderBy("_kl_b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.withColumn("before", F.coalesce(F.sum("s").over(upto), F.lit(0))).filter((F.col("before") < F.col("_kl_budget")) & (F.col("before") + F.col("s") >= F.col("_kl_budget")))
    found = {tuple(r[c] for c in leaf): (r["_kl_b"], r["before"]) for r in cuts.select(*leaf, "_kl_b", "before").toArrow().to_pylist()}
    taken = ordered([t if t[-2] is None else (*t[:-2], *found[t[: depth + 1]]) for t in todo])
    inside = taken.filter("_kl_cut IS NULL OR _kl_b < _kl_cut")
    run = Window.partitionBy(*leaf).orderBy("_kl_o", key, F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])).rowsBetween(Window.unboundedPreceding, -1)
    edge = taken.filter("_kl_b = _kl_cut").withColumn("_kl_run", F.coalesce(F.sum("_kl_n").over(run), F.lit(0))).filter(F.col("_kl_before") + F.col("_kl_run") < F.col("_kl_budget"))
    keep = [F.col(f"`{c}`") for c in [*names, "epoch"]]
    return inside.select(keep).unionByName(edge.select(keep))
