"""Container functions as column expressions.

Sets are sorted distinct arrays, maps sorted arrays of (k, v), multisets sorted arrays of (v, c), so that
all can be compared, grouped and collected.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _true, define, split_args


def as_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def as_multiset(x: Column) -> Column:
    """Of an array with repeats."""
    return F.transform(as_set(x), lambda v: F.struct(v.alias("v"), F.size(F.filter(x, lambda y: y == v)).cast("long").alias("c")))


def _sum_counts(x: Column) -> Column:
    """Of an array of (v, c) with repeated v."""
    values = as_set(F.transform(x, lambda e: e["v"]))
    total = lambda v: F.aggregate(F.filter(x, lambda e: e["v"] == v), F.lit(0).cast("long"), lambda n, e: n + e["c"])
    return F.filter(F.transform(values, lambda v: F.struct(v.alias("v"), total(v).alias("c"))), lambda e: e["c"] > 0)


def _count(m: Column, v: Column) -> Column:
    return F.aggregate(F.filter(m, lambda e: e["v"] == v), F.lit(0).cast("long"), lambda n, e: n + e["c"])


def _one(v: Column, c: int = 1) -> Column:
    return F.array(F.struct(v.alias("v"), F.lit(c).cast("long").alias("c")))


V, S, M, B, P = "Vec<$t>", "Set<$t>", "Map<$k,$v>", "MultiSet<$t>", "Pair<$a,$b>"
define("vec-of", "$t *", V, lambda *xs: F.array(*xs))
define("vec-append", f"{V} {V} *", V, lambda *xs: F.concat(*xs))
define("vec-push", f"{V} $t", V, F.array_append)
define("vec-pop", V, V, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
define("vec-length", V, "i64", lambda a: F.size(a).cast("long"))
define("vec-contains", f"{V} $t", "Unit", lambda a, x: _true(F.array_contains(a, x)))
define("vec-not-contains", f"{V} $t", "Unit", lambda a, x: _true(~F.array_contains(a, x)))
define("vec-get", f"{V} i64", "$t", lambda a, i: F.when((i >= 0) & (i < F.size(a)), F.get(a, i.cast("int"))))
define("vec-set", f"{V} i64 $t", V, lambda a, i, x: F.when((i >= 0) & (i < F.size(a)), F.transform(a, lambda y, k: F.when(k == i, x).otherwise(y))).otherwise(F.raise_error(F.lit("vec-set: no such place"))))
define("vec-remove", f"{V} i64", V, lambda a, i: F.when((i >= 0) & (i < F.size(a)), F.filter(a, lambda y, k: k != i)).otherwise(F.raise_error(F.lit("vec-remove: no such place"))))
define("vec-range", "i64", "Vec<i64>", lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")))).otherwise(F.array().cast("array<long>")))

define("set-of", "$t *", S, lambda *xs: as_set(F.array(*xs)))
#: Internal order has negative numbers last.
define("set-get", "Set<i64> i64", "i64", lambda a, i: F.when((i >= 0) & (i < F.size(a)), F.get(F.concat(F.filter(a, lambda x: x >= 0), F.filter(a, lambda x: x < 0)), i.cast("int"))))
define("set-insert", f"{S} $t", S, lambda a, x: F.array_sort(F.array_union(a, F.array(x))))
define("set-remove", f"{S} $t", S, F.array_remove)
define("set-length", S, "i64", lambda a: F.size(a).cast("long"))
define("set-contains", f"{S} $t", "Unit", lambda a, x: _true(F.array_contains(a, x)))
define("set-not-contains", f"{S} $t", "Unit", lambda a, x: _true(~F.array_contains(a, x)))
define("set-union", f"{S} {S}", S, lambda a, b: F.array_sort(F.array_union(a, b)))
define("set-diff", f"{S} {S}", S, lambda a, b: F.array_sort(F.array_except(a, b)))
define("set-intersect", f"{S} {S}", S, lambda a, b: F.array_sort(F.array_intersect(a, b)))

define("map-insert", f"{M} $k $v", M, lambda m, k, v: F.array_sort(F.concat(F.filter(m, lambda e: e["k"] != k), F.array(F.struct(k.alias("k"), v.alias("v"))))))
define("map-single", "$k $v", M, lambda k, v: F.array(F.struct(k.alias("k"), v.alias("v"))))
define("map-get", f"{M} $k", "$v", lambda m, k: F.get(F.filter(m, lambda e: e["k"] == k), F.lit(0))["v"])
define("map-remove", f"{M} $k", M, lambda m, k: F.filter(m, lambda e: e["k"] != k))
define("map-length", M, "i64", lambda m: F.size(m).cast("long"))
define("map-contains", f"{M} $k", "Unit", lambda m, k: _true(F.exists(m, lambda e: e["k"] == k)))
define("map-not-contains", f"{M} $k", "Unit", lambda m, k: _true(~F.exists(m, lambda e: e["k"] == k)))

define("pair", "$a $b", P, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
define("pair-first", P, "$a", lambda p: p["a"])
define("pair-second", P, "$b", lambda p: p["b"])

define("multiset-of", "$t *", B, lambda *xs: as_multiset(F.array(*xs)))
define("multiset-single", "$t i64", B, lambda x, n: F.array(F.struct(x.alias("v"), n.alias("c"))))
define("multiset-pick", B, "$t", lambda m: F.when(F.size(m) > 0, F.get(m, F.lit(0))["v"]).otherwise(F.raise_error(F.lit("multiset-pick: empty"))))
define("multiset-pick-max", B, "$t", lambda m: F.array_max(F.transform(m, lambda e: F.struct(e["c"].alias("c"), e["v"].alias("v"))))["v"])
define("multiset-insert", f"{B} $t", B, lambda m, x: _sum_counts(F.concat(m, _one(x))))
define("multiset-remove", f"{B} $t", B, lambda m, x: F.when(_count(m, x) > 0, _sum_counts(F.concat(m, _one(x, -1)))))
define("multiset-remove-swapped", f"$t {B}", B, lambda x, m: F.when(_count(m, x) > 0, _sum_counts(F.concat(m, _one(x, -1)))))
_less = lambda a, b: F.when(F.forall(b, lambda e: _count(a, e["v"]) >= e["c"]), _sum_counts(F.concat(a, F.transform(b, lambda e: F.struct(e["v"].alias("v"), (-e["c"]).alias("c"))))))
define("multiset-subtract", f"{B} {B}", B, _less)
define("multiset-subtract-swapped", f"{B} {B}", B, lambda a, b: _less(b, a))
define("multiset-length", B, "i64", lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda n, e: n + e["c"]))
define("multiset-count", f"{B} $t", "i64", _count)
define("multiset-contains", f"{B} $t", "Unit", lambda m, x: _true(_count(m, x) > 0))
define("multiset-not-contains", f"{B} $t", "Unit", lambda m, x: _true(_count(m, x) == 0))
define("multiset-contains-swapped", f"$t {B}", "Unit", lambda x, m: _true(_count(m, x) > 0))
define("multiset-not-contains-swapped", f"$t {B}", "Unit", lambda x, m: _true(_count(m, x) == 0))
define("multiset-sum", f"{B} {B}", B, lambda a, b: _sum_counts(F.concat(a, b)))
define("multiset-intersection", f"{B} {B}", B, lambda a, b: F.filter(F.transform(a, lambda e: F.struct(e["v"].alias("v"), F.least(e["c"], _count(b, e["v"])).alias("c"))), lambda e: e["c"] > 0))
define("multiset-reset-counts", B, B, lambda a: F.transform(a, lambda e: F.struct(e["v"].alias("v"), F.lit(1).cast("long").alias("c"))))

#: Empty containers; what they hold is found from where they stand.
EMPTY = {"vec-empty": "Vec<?>", "set-empty": "Set<?>", "map-empty": "Map<?,?>"}


def _scaled(outer: Column) -> Column:
    """All (v, c) of multisets in a multiset, counts multiplied."""
    return F.flatten(F.transform(outer, lambda e: F.transform(e["v"], lambda i: F.struct(i["v"].alias("v"), (i["c"] * e["c"]).alias("c")))))


define("multiset-sum-multisets", "MultiSet<MultiSet<$t>>", B, lambda m: _sum_counts(_scaled(m)))


def id_elements(value: Column, sort: str, is_id) -> Column | None:
    """All ids in a container value as one array; None if its sort has none."""
    kind, parts = sort.split("<", 1)[0], split_args(sort)
    inner = [(None if "<" not in p else p, is_id(p)) for p in parts]

    def part(name: str | None):
        return lambda e: e[name] if name else e

    def of(x: Column, k: int) -> Column | None:
        return F.array(x) if inner[k][1] else id_elements(x, inner[k][0], is_id) if inner[k][0] else None

    fields = {"Vec": [None], "Set": [None], "MultiSet": ["v"], "Map": ["k", "v"], "Pair": ["a", "b"]}.get(kind, [])
    found = []
    for k, name in enumerate(fields):
        if kind == "Pair":
            found.append(of(value[name], k))
        elif inner[k][1]:
            found.append(F.transform(value, part(name)))
        elif inner[k][0] and of(F.lit(None), k) is not None:
            found.append(F.flatten(F.transform(F.transform(value, part(name)), partial(lambda k, e: of(e, k), k))))
    found = [f for f in found if f is not None]
    return F.concat(*found) if found else None


def renamed(value: Column, sort: str, is_id, name) -> Column:
    """A container value with ``name`` put on every id in it, and in order again."""
    kind, parts = sort.split("<", 1)[0], split_args(sort)
    on = lambda x, k: name(x) if is_id(parts[k]) else renamed(x, parts[k], is_id, name) if "<" in parts[k] else x
    if kind == "Vec":
        return F.transform(value, lambda e: on(e, 0))
    if kind == "Set":
        return as_set(F.transform(value, lambda e: on(e, 0)))
    if kind == "MultiSet":
        return _sum_counts(F.transform(value, lambda e: F.struct(on(e["v"], 0).alias("v"), e["c"].alias("c"))))
    if kind == "Pair":
        return F.struct(on(value["a"], 0).alias("a"), on(value["b"], 1).alias("b"))
    if kind == "Map":
        # Of keys that become one, the greatest value stays.
        entries = F.transform(value, lambda e: F.struct(on(e["k"], 0).alias("k"), on(e["v"], 1).alias("v")))
        keys = as_set(F.transform(entries, lambda e: e["k"]))
        return F.transform(keys, lambda k: F.array_max(F.filter(entries, lambda e: e["k"] == k)))
    return value
