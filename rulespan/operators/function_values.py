"""Function values, and the container functions that take them or write.

A function value is a struct of a name and what the function has been given already, as text. Where it is applied,
the names that the program's text gives to ``unstable-fn`` are the candidates, each a column function or a table
of the right sorts, so that rows of different functions are handled in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import containers, scalar
from ..plans.parser import Lit, ProgramError
from ..plans.rules import applied
from ..plans.sorts import spark_type


def fn_sort(args: list[str], out: str) -> str:
    return f"UnstableFn<Args<{','.join(args)}>,{out}>"


def fn_parts(sort: str) -> tuple[list[str], str]:
    args, out = scalar.split_args(sort)
    return [a for a in scalar.split_args(args) if a], out


def encoded(c: Column, sort: str) -> Column:
    return F.to_json(F.struct(c.alias("x"))) if "<" in sort or sort == "BigRat" else c.cast("string")


def decoded(text: Column, sort: str) -> Column:
    if "<" in sort or sort == "BigRat":
        return F.from_json(text, T.StructType().add("x", spark_type(sort)))["x"]
    return text.try_cast(spark_type(sort))


def repeated(m: Column) -> Column:
    """A multiset's elements, each as often as it counts."""
    return F.flatten(F.transform(m, lambda e: F.array_repeat(e["v"], e["c"].cast("int"))))


class FunctionValues:
    """The part of a program that evaluates what isn't a column function of its arguments."""

    SPECIAL = (
        "unstable-fn unstable-app unstable-vec-map unstable-multiset-map unstable-multiset-flat-map unstable-multiset-filter unstable-multiset-filter-not "
        "unstable-multiset-reduce unstable-multiset-fill-index unstable-multiset-clear-index vec-union multiset-union-values"
    ).split()

    def fn_target(self, name: str, given: list[str]) -> tuple[list[str], str] | None:
        """What a named function still takes and gives, once it has arguments of the sorts given."""
        t = self.tables.get(name)
        if t:
            return (t.args[len(given) :], t.out or "Unit") if t.args[: len(given)] == given else None
        for wanted, _, result in scalar.TABLE.get(name, []):
            plain = [w for w in wanted if w != "*"]
            if plain[: len(given)] == given and not any(c in "".join(wanted) for c in "$?"):
                return plain[len(given) :], result
        return None

    def special(self, name: str, df: DataFrame, x: list, effects, sorts: dict[str, str], rule: bool, want: str | None) -> tuple[DataFrame, Column, str]:
        args = x[1:]
        if name == "unstable-fn":
            return self._function(df, args, effects, sorts, rule, want)
        cols, kinds = [], []
        for a in args:
            df, c, s = self._value(df, a, effects, sorts, rule)
            cols.append(c)
            kinds.append(s)

        def bad() -> ProgramError:
            return ProgramError(f"{name}: no definition for {' '.join(kinds)}")

        if name == "vec-union":
            if len(kinds) != 2 or kinds[0] != kinds[1] or not self.is_id(scalar.split_args(kinds[0])[0]):
                raise bad()
            same = F.size(cols[0]) == F.size(cols[1])
            pairs = df.where(same).select(F.explode(F.arrays_zip(cols[0].alias("a"), cols[1].alias("b"))).alias("z"))
            effects.edges.append(pairs.select(F.col("z")["a"].alias("a"), F.col("z")["b"].alias("b")).where("a <> b"))
            return df, F.when(same, cols[0]), kinds[0]
        if name == "multiset-union-values":
            of = scalar.split_args(kinds[0])[0]
            if not kinds[0].startswith("MultiSet<") or not self.is_id(of):
                raise bad()
            first = F.get(cols[0], F.lit(0))["v"]
            effects.edges.append(df.select(first.alias("a"), F.explode(cols[0]).alias("e")).select("a", F.col("e.v").alias("b")).where("a <> b"))
            return df, first, of
        where = 1 if name.endswith("-index") else 0
        if not kinds[where].startswith("UnstableFn<"):
            raise bad()
        takes, gives = fn_parts(kinds[where])
        if name == "unstable-app":
            if takes != kinds[1:]:
                raise bad()
            df, value = self._apply_fn(df, cols[0], cols[1:], takes, gives, effects)
            return df, value, gives
        if name.endswith("-index"):
            return self._index(name, df, cols, kinds, takes, gives, effects)
        # Elements are taken apart by rows of a written table, whose numbers stay.
        at = f"_m{len(df.columns)}"
        df = df.select("*", *[c.alias(f"{at}_{k}") for k, c in enumerate(cols)])
        df = self.store.keep(df.withColumn(f"{at}_row", F.monotonically_increasing_id()))
        fn, held = F.col(f"{at}_0"), F.col(f"{at}_{len(cols) - 1}")
        of = scalar.split_args(kinds[-1])[0]
        if name == "unstable-multiset-reduce":
            return self._reduce(df, at, fn, F.col(f"{at}_1"), repeated(held), of, gives, effects)
        if takes != [of]:
            raise bad()
        vec = name == "unstable-vec-map"
        each = df.select(f"{at}_row", fn.alias(f"{at}_f"), F.posexplode(held).alias("pos", "e"))
        element = F.col("e") if vec else F.col("e.v")
        each, value = self._apply_fn(each, F.col(f"{at}_f"), [element], takes, gives, effects)
        filtering = "filter" in name
        if filtering:
            value = F.when(value.isNull() if name.endswith("-not") else value.isNotNull(), element)
        elif name == "unstable-multiset-flat-map":
            # Of an element without a result the element stays.
            count = F.col("e.c")
            inner = F.transform(value, lambda i: F.struct(i["v"].alias("v"), (i["c"] * count).alias("c")))
            value = F.coalesce(inner, F.array(F.struct(element.alias("v"), count.alias("c"))))
        out = of if filtering else gives
        flat = name == "unstable-multiset-flat-map"
        item = value if vec or flat else F.struct(value.alias("v"), F.col("e.c").alias("c"))
        kept = each.withColumn("value", value).where(F.col("value").isNotNull()).select(f"{at}_row", F.struct("pos", item.alias("item")).alias("z"))
        lists = kept.groupBy(f"{at}_row").agg(F.transform(F.array_sort(F.collect_list("z")), lambda z: z["item"]).alias(f"{at}_list"))
        df = df.join(lists, f"{at}_row", "left")
        result = f"Vec<{out}>" if vec else gives if flat else f"MultiSet<{out}>"
        empty = F.array().cast(spark_type(result))
        if vec:
            return df, F.coalesce(F.col(f"{at}_list"), empty), result
        whole = F.flatten(F.col(f"{at}_list")) if flat else F.col(f"{at}_list")
        return df, F.coalesce(containers._sum_counts(whole), empty), result

    def _function(self, df: DataFrame, args: list, effects, sorts: dict[str, str], rule: bool, want: str | None) -> tuple[DataFrame, Column, str]:
        if not args or not isinstance(args[0], Lit) or args[0].sort != "String":
            raise ProgramError("unstable-fn takes the name of a function")
        name, given, kinds = args[0].value, [], []
        for a in args[1:]:
            df, c, s = self._value(df, a, effects, sorts, rule)
            given.append(encoded(c, s))
            kinds.append(s)
        if want and want.startswith("UnstableFn<"):
            takes, gives = fn_parts(want)
            t = self.tables.get(name)
            fits = (t.args == [*kinds, *takes] and (t.out or "Unit") == gives) if t else (r := scalar.resolve(name, [*kinds, *takes])) and r[1] == gives
            if not fits:
                raise ProgramError(f"unstable-fn: {name} is no function from {' '.join(takes) or 'nothing'} to {gives}")
            sort = want
        else:
            target = self.fn_target(name, kinds)
            if target is None:
                raise ProgramError(f"unstable-fn: no function {name} takes {' '.join(kinds)}")
            sort = fn_sort(*target)
        self.fn_uses.add((name, tuple(kinds)))
        return df, F.struct(F.lit(name).alias("f"), (F.array(*given) if given else F.array()).cast("array<string>").alias("given")), sort

    def _candidates(self, kinds: list[str], out: str):
        for name, given in sorted(self.fn_uses):
            t, full = self.tables.get(name), [*given, *kinds]
            if t and t.args == full and (t.out or "Unit") == out:
                yield name, list(given), t
            elif not t and (r := scalar.resolve(name, full)) and r[1] == out:
                yield name, list(given), None

    def _apply_fn(self, df: DataFrame, fn: Column, cols: list[Column], kinds: list[str], out: str, effects) -> tuple[DataFrame, Column]:
        """The value of a function on each row; null where it has none."""
        values: list[Column] = []
        for name, given, t in self._candidates(kinds, out):
            here = (fn["f"] == name) & (F.size(fn["given"]) == len(given))
            full = [*[decoded(F.get(fn["given"], F.lit(k)), s) for k, s in enumerate(given)], *cols]
            if t:
                df, value = self._call(df, t, full, effects, here)
                values.append(value)
            else:
                values.append(F.when(here, applied(name, full, [*given, *kinds])[0]))
        if not values:
            return df, F.lit(None).cast(spark_type(out))
        return df, F.coalesce(*values)

    def _reduce(self, df: DataFrame, at: str, fn: Column, initial: Column, items: Column, of: str, gives: str, effects) -> tuple[DataFrame, Column, str]:
        """Folds from the first element; ``initial`` only where there is none. As many rounds as the largest multiset has elements."""
        df = df.withColumn(f"{at}_items", items)
        most = df.agg(F.max(F.size(f"{at}_items"))).first()[0] or 0
        value = F.coalesce(F.get(F.col(f"{at}_items"), F.lit(0)), initial)
        df = df.withColumn(f"{at}_acc", value)
        for k in range(1, most):
            there = F.size(f"{at}_items") > k
            df, value = self._apply_fn(df, F.when(there, fn), [F.col(f"{at}_acc"), F.get(F.col(f"{at}_items"), F.lit(k))], [of, of], gives, effects)
            df = self.store.keep(df.withColumn(f"{at}_acc", F.when(there, value).otherwise(F.col(f"{at}_acc"))))
        return df, F.col(f"{at}_acc"), gives

    def _index(self, name: str, df: DataFrame, cols: list[Column], kinds: list[str], takes: list[str], gives: str, effects) -> tuple[DataFrame, Column, str]:
        """Rows of a function for each element of a multiset: its count, or none any more."""
        of = scalar.split_args(kinds[0])[0]
        if takes != [kinds[0], of] or gives != "i64":
            raise ProgramError(f"{name}: no definition for {' '.join(kinds)}")
        tables = [(n, t) for n, given, t in self._candidates(takes, gives) if t and not given and t.kind == "function"]
        for n, t in tables:
            each = df.where(cols[1]["f"] == n).select(cols[0].alias("k0"), F.explode(cols[0]).alias("e")).select("k0", F.col("e.v").alias("k1"), F.col("e.c").alias("ret"))
            if name.endswith("clear-index"):
                effects.removed.setdefault(n, []).append(each.select("k0", "k1").distinct())
            else:
                # A multiset that has a row has them all.
                fresh = each.join(self.store.read(t).select("k0").distinct(), "k0", "left_anti")
                effects.staged.setdefault(n, []).append(fresh.select(*t.columns, F.lit(False).alias("sub")).distinct())
        return df, F.lit(True), "Unit"


def moved_values(values: DataFrame, sort: str, is_id, moved: DataFrame) -> DataFrame | None:
    """``old, new`` of the container values in ``old`` that hold a moved id (``node, root``); None if the sort has no ids."""
    ids = containers.id_elements(F.col("old"), sort, is_id)
    if ids is None:
        return None
    hits = values.select("old", F.explode(F.array_distinct(ids)).alias("node")).join(moved, "node")
    names = hits.groupBy("old").agg(F.map_from_entries(F.collect_list(F.struct("node", "root"))).alias("names"))
    name = lambda x: F.coalesce(F.element_at(F.col("names"), x), x)
    return names.select("old", containers.renamed(F.col("old"), sort, is_id, name).alias("new"))


def moved_functions(values: DataFrame, uses: set, is_id, moved: DataFrame) -> DataFrame | None:
    """``old, new`` of the function values that were given a moved id."""
    found = []
    for name, given in sorted(uses):
        places = [k for k, s in enumerate(given) if is_id(s)]
        if not places:
            continue
        rows = values.where((F.col("old.f") == name) & (F.size("old.given") == len(given)))
        for k in places:
            at = moved.select(F.col("node").cast("string").alias(f"n{k}"), F.col("root").cast("string").alias(f"r{k}"))
            rows = rows.withColumn(f"n{k}", F.get("old.given", F.lit(k))).join(at, f"n{k}", "left")
        hit = reduce(lambda a, b: a | b, [F.col(f"r{k}").isNotNull() for k in places])
        new = [F.coalesce(F.col(f"r{k}"), F.get("old.given", F.lit(k))) if k in places else F.get("old.given", F.lit(k)) for k in range(len(given))]
        found.append(rows.where(hit).select("old", F.struct(F.lit(name).alias("f"), F.array(*new).alias("given")).alias("new")))
    return reduce(DataFrame.unionByName, found) if found else None
