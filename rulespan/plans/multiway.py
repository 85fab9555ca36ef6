"""Other ways to join the atoms of a query than two at a time.

``generic`` binds one variable after another (Ngo et al., 2012): each prefix is extended from the table that has the
fewest values for it, and the other tables only test, so that what lies between is never more than the worst case of the
result, as in cyclic patterns. ``reduced`` is for acyclic patterns (Yannakakis, 1981): semi-joins leave in each table only
rows that are in some match, before anything is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variables(frames: list[DataFrame]) -> list[set[str]]:
    return [{c for c in f.columns if not c.startswith("_unit_")} for f in frames]


def quoted(names) -> list:
    return [F.col(f"`{n}`") for n in sorted(names)]


def tree(names: list[set[str]]) -> list[tuple[int, int]] | None:
    """Pairs (ear, parent) in the order of removal; None if the pattern is cyclic or falls apart."""
    left, out = list(range(len(names))), []
    while len(left) > 1:
        for e in left:
            others = [f for f in left if f != e]
            shared = names[e] & set().union(*(names[f] for f in others))
            parent = next((f for f in others if shared and shared <= names[f]), None)
            if parent is not None:
                out.append((e, parent))
                left.remove(e)
                break
        else:
            return None
    return out


def reduced(frames: list[DataFrame]) -> list[DataFrame] | None:
    """The frames without rows that are in no match, of an acyclic pattern; None for others."""
    names = variables(frames)
    order = tree(names)
    if order is None:
        return None
    out = list(frames)
    semi = lambda a, b: out[a].join(out[b].select(*quoted(names[a] & names[b])).distinct(), sorted(names[a] & names[b]), "left_semi")
    for ear, parent in order:
        out[parent] = semi(parent, ear)
    for ear, parent in reversed(order):
        out[ear] = semi(ear, parent)
    return out


def order_of(names: list[set[str]]) -> list[str]:
    """Variables of many atoms first, each next to ones that are bound."""
    left, out = set().union(*names), []
    while left:
        near = [v for v in left if any(v in n and n & set(out) for n in names)] or sorted(left)
        v = max(sorted(near), key=lambda v: (sum(v in n for n in names), sum(len(n & set(out)) for n in names if v in n)))
        out.append(v)
        left.remove(v)
    return out


def generic(frames: list[DataFrame]) -> DataFrame:
    """All matches, a column for each variable."""
    names = variables(frames)
    units = [f for f, n in zip(frames, names, strict=True) if not n]
    sides = [(f, n) for f, n in zip(frames, names, strict=True) if n]
    bound: list[str] = []
    prefix: DataFrame | None = None
    for v in order_of([n for _, n in sides]):
        tables = []
        for f, n in sides:
            if v in n:
                keys = [b for b in bound if b in n]
                tables.append((f.select(*quoted({*keys, v})).distinct(), keys))
        if prefix is None:
            prefix = reduce(lambda a, b: a.join(b, v, "left_semi"), [t for t, _ in tables])
        elif not any(keys for _, keys in tables):
            values = reduce(lambda a, b: a.join(b, v, "left_semi"), [t for t, _ in tables])
            prefix = prefix.join(values)
        else:
            # How many values each table has for a prefix; one without keys has as many for all.
            counted = prefix
            for k, (t, keys) in enumerate(tables):
                many = t.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias(f"_n{k}"))
                counted = counted.join(many, keys) if keys else counted.join(F.broadcast(many))
            least = F.least(*[F.col(f"_n{k}") for k in range(len(tables))]) if len(tables) > 1 else F.col("_n0")
            parts = []
            for k, (t, keys) in enumerate(tables):
                mine = reduce(lambda a, j: a & (F.col(f"_n{j}") > least), range(k), F.col(f"_n{k}") == least)
                rows = counted.where(mine).select(*[F.col(f"`{b}`") for b in bound])
                rows = rows.join(t, keys) if keys else rows.join(t)
                for j, (other, others) in enumerate(tables):
                    if j != k:
                        rows = rows.join(other, [*others, v], "left_semi")
                parts.append(rows.select(*[F.col(f"`{b}`") for b in [*bound, v]]))
            prefix = reduce(DataFrame.unionByName, parts)
        bound.append(v)
    for u in units:
        prefix = u if prefix is None else prefix.join(u.limit(1))
    return prefix
