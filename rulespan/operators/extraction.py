"""Cheapest terms of ids, and values as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containers, scalar
from ..plans.parser import ProgramError, read
from .function_values import decoded, repeated
from .store import Table

UNEXTRACTABLE = "Unextractable"


class CostModel:
    """Additive costs: what a row adds to its arguments' costs, and what a base value costs. Override to change them."""

    def row(self, table: Table, children: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, children, F.lit(table.cost).cast("long"))

    def value(self, sort: str, c: Column) -> Column:
        return F.lit(1).cast("long")

    def container(self, sort: str, elements: Column) -> Column:
        """Of an array of the elements' costs."""
        return F.aggregate(elements, F.lit(0).cast("long"), lambda n, x: n + x)


class UnitCosts(CostModel):
    """Every row costs one, values nothing: the fewest rows."""

    def row(self, table: Table, children: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, children, F.lit(1).cast("long"))

    def value(self, sort: str, c: Column) -> Column:
        return F.lit(0).cast("long")


def quoted(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def call(name: str | Column, *words: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(" ", name if isinstance(name, Column) else F.lit(name), *words), F.lit(")"))


def shown(c: Column, sort: str, is_id, term, uses: set = frozenset()) -> Column:
    """A value as text; ``term`` gives that of an id."""
    if is_id(sort):
        return term(c)
    if sort == "String":
        return quoted(c)
    if sort == "Unit":
        return F.lit("()")
    if sort == "BigInt":
        return call("bigint", c.cast("string"))
    if sort == "BigRat":
        return call("bigrat", call("bigint", c["num"].cast("string")), call("bigint", c["den"].cast("string")))
    if "<" not in sort:
        return scalar.find("to-string", [sort])[0](c) if scalar.find("to-string", [sort]) else c.cast("string")
    kind, parts = sort.split("<", 1)[0], scalar.split_args(sort)
    if kind == "UnstableFn":
        out = call("unstable-fn", quoted(c["f"]))
        for name, given in sorted(uses):
            words = [shown(decoded(F.get(c["given"], F.lit(k)), s), s, is_id, term, uses) for k, s in enumerate(given)]
            out = F.when((c["f"] == name) & (F.size(c["given"]) == len(given)), call("unstable-fn", quoted(c["f"]), *words)).otherwise(out)
        return out
    on = lambda x, k: shown(x, parts[k], is_id, term, uses)
    if kind in ("Vec", "Set"):
        return F.when(F.size(c) == 0, call(f"{kind.lower()}-empty")).otherwise(call(f"{kind.lower()}-of", F.array_join(F.transform(c, lambda e: on(e, 0)), " ")))
    if kind == "MultiSet":
        return F.when(F.size(c) == 0, call("multiset-of")).otherwise(call("multiset-of", F.array_join(F.transform(repeated(c), lambda e: on(e, 0)), " ")))
    if kind == "Pair":
        return call("pair", on(c["a"], 0), on(c["b"], 1))
    return F.aggregate(c, F.lit("(map-empty)"), lambda s, e: F.concat(F.lit("(map-insert "), s, F.lit(" "), on(e["k"], 0), F.lit(" "), on(e["v"], 1), F.lit(")")))


def element_costs(c: Column, sort: str, is_id, cost, model: CostModel) -> Column:
    """What a value costs; ``cost`` gives that of an id."""
    if is_id(sort):
        return cost(c)
    if "<" not in sort or sort.startswith("UnstableFn<"):
        return model.value(sort, c)
    kind, parts = sort.split("<", 1)[0], scalar.split_args(sort)
    on = lambda x, k: element_costs(x, parts[k], is_id, cost, model)
    if kind == "Pair":
        return model.container(sort, F.array(on(c["a"], 0), on(c["b"], 1)))
    if kind == "Map":
        return model.container(sort, F.flatten(F.transform(c, lambda e: F.array(on(e["k"], 0), on(e["v"], 1)))))
    return model.container(sort, F.transform(repeated(c) if kind == "MultiSet" else c, lambda e: on(e, 0)))


class Extraction:
    """The part of a program that finds terms."""

    def _described(self, df: DataFrame, names: list[str], sorts: list[str], best: DataFrame | None, model: CostModel, lenient: bool = False) -> DataFrame:
        """``df`` with ``<name>_term`` and ``<name>_cost`` for each column; rows with an id that has no term are left out, or say so."""
        missing = (F.lit(UNEXTRACTABLE), F.lit(0).cast("long"))
        for c, sort in zip(names, sorts, strict=True):
            if self.is_id(sort):
                known = best.select(F.col("id").alias(c), F.col("term").alias(f"{c}_term"), F.col("cost").alias(f"{c}_cost"))
                df = df.join(known, c, "left" if lenient else "inner")
                if lenient:
                    df = df.withColumns({f"{c}_term": F.coalesce(F.col(f"{c}_term"), missing[0]), f"{c}_cost": F.coalesce(F.col(f"{c}_cost"), missing[1])})
                continue
            ids = containers.id_elements(F.col(c), sort, self.is_id) if "<" in sort and not sort.startswith("UnstableFn<") else None
            if ids is None:
                plain = lambda x: x.cast("string")
                df = df.withColumns({f"{c}_term": shown(F.col(c), sort, self.is_id, plain, self.fn_uses), f"{c}_cost": element_costs(F.col(c), sort, self.is_id, None, model)})
                continue
            # The terms of all ids in a container value, found once for each distinct value.
            values = df.select(c).distinct().withColumn("ids", F.array_distinct(ids))
            known = values.select(c, F.explode_outer("ids").alias("id")).join(best, "id", "left")
            known = known.groupBy(c).agg(F.map_from_entries(F.collect_list(F.when(F.col("id").isNotNull() & F.col("term").isNotNull(), F.struct("id", F.struct("term", "cost"))))).alias("m"), F.count("id").alias("wanted"), F.count("term").alias("found"))
            if not lenient:
                known = known.where("wanted = found")
            of = lambda x, part, k: F.coalesce(F.element_at(F.col("m"), x)[part], missing[k])
            known = known.select(c, shown(F.col(c), sort, self.is_id, lambda x: of(x, "term", 0), self.fn_uses).alias(f"{c}_term"), element_costs(F.col(c), sort, self.is_id, lambda x: of(x, "cost", 1), model).alias(f"{c}_cost"))
            df = df.join(known, c)
        return df

    def reachable(self, sort: str | None) -> set[str]:
        """Constructors that a term of a sort can hold; all if no sort is given."""
        made = {n: t for n, t in self.tables.items() if t.kind == "constructor" and t.extractable}
        if sort is None:
            return set(made)
        todo, seen, found = [sort], set(), set()
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            if "<" in s:
                todo += [a for a in scalar.split_args(s) if a]
            for n, t in made.items():
                if t.out == s and n not in found:
                    found.add(n)
                    todo += t.args
        return found

    def term_costs(self, hidden: bool = False, model: CostModel | None = None, sort: str | None = None) -> DataFrame:
        """``id, cost, term``: the cheapest term of every class; of equal costs the term that sorts first.

        With ``sort``, only tables that terms of that sort can hold are read. Hidden rows take no part unless ``hidden``.
        """
        model, tables = model or CostModel(), self.reachable(sort)
        best: DataFrame | None = None
        last = None
        while True:
            found = self._nodes(best, model, tables, hidden)
            if found is None:
                return self.spark.createDataFrame([], "id long, cost long, term string")
            after = self.store.keep(found.groupBy("id").agg(F.min(F.struct("cost", "term")).alias("b")).select("id", "b.cost", "b.term"))
            state = tuple(after.agg(F.count(F.lit(1)), F.sum("cost"), F.bit_xor(F.xxhash64("id", "cost", "term"))).first())
            if best is not None and state == last:
                return after
            best, last = after, state

    def _nodes(self, best: DataFrame | None, model: CostModel, tables: set[str], hidden: bool = False) -> DataFrame | None:
        """``id, cost, term`` of every constructor row whose arguments have terms already."""
        parts = []
        for name in sorted(tables):
            t = self.tables[name]
            with_ids = any(i < len(t.args) and not (i in t.boxed and t.boxed[i].startswith("UnstableFn<")) for i in [*t.ids, *t.boxed])
            if not t.rows or with_ids and best is None:
                continue
            df = self.store.read(t)
            df = self._described(df if hidden else df.where(~F.col("sub")), t.keys, t.args, best, model)
            cost = model.row(t, [F.col(f"{k}_cost") for k in t.keys])
            parts.append(df.select(F.col("ret").alias("id"), cost.cast("long").alias("cost"), call(name, *[F.col(f"{k}_term") for k in t.keys]).alias("term")))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def extract(self, x, n: int | None = None, model: CostModel | None = None) -> list[tuple[int, str]]:
        """The cheapest term equal to an expression, or the n cheapest rows of its class as terms."""
        from .program import Effects

        x, model = read(x)[0] if isinstance(x, str) else x, model or CostModel()
        effects = Effects()
        df, c, sort = self._value(self.spark.range(1).select(), x, effects, {}, False)
        value = self.store.keep(df.select(c.alias("v")))
        if effects.staged:
            self._apply(effects)
        if not self.is_id(sort):
            best = self.term_costs(model=model, sort=sort) if "<" in sort else None
            row = self._described(value, ["v"], [sort], best, model).select("v_cost", "v_term").first()
            if row is None:
                raise ProgramError("nothing to extract")
            return [tuple(row)]
        best = self.term_costs(model=model, sort=sort)
        source = best if not n else self._nodes(best, model, self.reachable(sort))
        if source is None:
            raise ProgramError("nothing to extract")
        found = source.join(value.withColumnRenamed("v", "id"), "id").orderBy("cost", "term").limit(n or 1).collect()
        if not found:
            raise ProgramError("nothing to extract")
        return [(r["cost"], r["term"]) for r in found]

    def terms(self, name: str, model: CostModel | None = None) -> DataFrame:
        """A table's rows as text, hidden ones included: a column for each key, and ``ret``."""
        t, model = self.tables[name], model or CostModel()
        sorts = [*t.args, *([t.out] if t.out else [])]
        needed = [s for s in sorts if self.is_id(s) or "<" in s]
        best = self.term_costs(model=model) if needed else None
        rows = self._described(self.store.read(t).select(*t.columns), t.columns, sorts, best, model, lenient=True)
        return rows.select(*[F.col(f"{c}_term").alias(c) for c in t.columns])
