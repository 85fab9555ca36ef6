"""Looking into a program's tables from outside its rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.containers import id_elements
from ..plans.parser import ProgramError


class Inspection:
    """Lookups, row iteration, statistics, draining, differences and printing."""

    def _table(self, name: str):
        if name not in self.tables:
            raise ProgramError(f"unbound function {name}")
        return self.tables[name]

    def lookup(self, name: str, *keys):
        """The value for one key, None if there is none; of a relation, whether the row is there. Ids are numbers."""
        t = self._table(name)
        if len(keys) != len(t.args):
            raise ProgramError(f"{name} takes {len(t.args)} arguments, not {len(keys)}")
        rows = self.store.read(t)
        for k, v in zip(t.keys, keys, strict=True):
            rows = rows.where(F.col(k) == F.lit(v).cast(t.schema[k].dataType))
        row = rows.select(*t.columns[len(t.keys) :]).first()
        return row is not None if t.out is None else row and row[0]

    def for_each(self, name: str, f: Callable[[tuple], object]) -> int:
        """Calls ``f`` with every row, partition by partition, until it returns False; how many rows it saw."""
        n = 0
        for row in self.rows(name).toLocalIterator(prefetchPartitions=False):
            n += 1
            if f(tuple(row)) is False:
                break
        return n

    def statistics(self, name: str) -> dict:
        """Rows, written segments, the last step that changed any, and about how many distinct values each column has."""
        t = self._table(name)
        rows = self.store.read(t)
        shown = rows.select(*[F.approx_count_distinct(F.hash(c)).alias(c) for c in t.columns]).first() if t.columns else ()
        return {"rows": t.rows, "segments": len(t.parts), "last_step": t.last, "distinct": dict(zip(t.columns, shown, strict=True))}

    def drain(self, name: str) -> DataFrame:
        """A relation's rows, which are gone from it afterwards; the rows stay readable."""
        t = self._table(name)
        if t.kind != "relation":
            raise ProgramError(f"{name} is no relation")
        rows = self.rows(name)
        t.clear()
        self.step += 1
        return rows

    def changed_since(self, name: str, step: int) -> DataFrame:
        """Rows that are new or changed since the program was at a step; older segments aren't opened."""
        t = self._table(name)
        return self.store.read(t, since=step).select(*t.columns)

    def difference_to(self, other) -> dict[str, tuple[DataFrame, DataFrame]]:
        """For each table of either program: rows that only this one has, and rows that only the other has."""
        out = {}
        for name in sorted({*self.tables, *other.tables}):
            mine, theirs = (p.rows(name) if name in p.tables else None for p in (self, other))
            if mine is None or theirs is None:
                there = mine if mine is not None else theirs
                out[name] = (there, there.limit(0)) if theirs is None else (there.limit(0), there)
            else:
                out[name] = (mine.exceptAll(theirs), theirs.exceptAll(mine))
        return out

    def occurrences(self, value: int) -> dict[str, DataFrame]:
        """Rows that hold an id, by table, in containers too: what a union of it would touch."""
        out = {}
        for name, t in self.tables.items():
            hit = [F.col(t.columns[i]) == F.lit(value) for i in t.ids]
            for i, sort in t.boxed.items():
                c = F.col(t.columns[i])
                ids = None if sort.startswith("UnstableFn<") else id_elements(c, sort, self.is_id)
                hit.append(F.array_contains(c["given"], F.lit(str(value))) if ids is None else F.array_contains(ids, F.lit(value)))
            if hit and t.rows:
                out[name] = self.rows(name).where(reduce(lambda a, b: a | b, hit))
        return out

    def colours(self, rounds: int = 64) -> DataFrame:
        """``id, colour``: ids of one colour stand in like rows as far as colour refinement tells; names of ids don't count.

        A round hashes each row by its table, values and its ids' colours, and gives each id the sum over its rows; sums
        are made before the shuffle, so an id in very many rows is no problem. Ends when no more colours come.
        """
        tables = [t for t in self.tables.values() if t.ids and t.rows and not t.boxed]
        ids = [self.rows(t.name).select(F.col(t.columns[i]).alias("id"), F.xxhash64(F.lit(([*t.args, t.out])[i])).alias("colour")) for t in tables for i in t.ids]
        if not ids:
            return self.spark.createDataFrame([], "id long, colour long")
        now = self.store.keep(reduce(DataFrame.unionByName, ids).distinct())
        kinds = now.select("colour").distinct().count()
        for _ in range(rounds):
            seen = []
            for t in tables:
                rows = self.rows(t.name)
                for i in t.ids:
                    rows = rows.join(now.select(F.col("id").alias(t.columns[i]), F.col("colour").alias(f"colour{i}")), t.columns[i])
                parts = [F.col(f"colour{i}") if i in t.ids else F.col(c) for i, c in enumerate(t.columns)]
                row = F.xxhash64(F.lit(t.name), *parts)
                seen += [rows.select(F.col(t.columns[i]).alias("id"), F.xxhash64(row, F.lit(i)).alias("part")) for i in t.ids]
            sums = reduce(DataFrame.unionByName, seen).groupBy("id").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("parts"))
            now = self.store.keep(now.join(sums, "id").select("id", F.xxhash64("colour", "parts").alias("colour")))
            more = now.select("colour").distinct().count()
            if more == kinds:
                break
            kinds = more
        return now

    def told_apart(self, other, rounds: int = 8) -> bool:
        """Whether two programs surely differ by more than the names of their ids: sizes, rows without ids, or colours differ.

        False means that refinement finds no difference, which for graphs of much symmetry isn't a proof.
        """
        if {n: t.rows for n, t in self.tables.items()} != {n: t.rows for n, t in other.tables.items()}:
            return True
        for n, t in self.tables.items():
            if not t.ids and not t.boxed and self.rows(n).exceptAll(other.rows(n)).take(1):
                return True
        mine, theirs = (p.colours(rounds).groupBy("colour").count() for p in (self, other))
        return bool(mine.exceptAll(theirs).take(1) or theirs.exceptAll(mine).take(1))

    def print_function(self, name: str, n: int | None = None, path: str | None = None, mode: str = "default") -> list[str]:
        """Rows as terms, hidden ones included, in order of their text: printed, or written as lines of terms or of CSV."""
        t = self._table(name)
        rows = self.terms(name).orderBy(*t.columns) if t.columns else self.terms(name)
        if n is not None:
            rows = rows.limit(n)
        if mode == "csv":
            lines = rows.select(F.to_csv(F.struct(F.lit(name).alias("f"), *t.columns)).alias("value"))
        elif mode == "default":
            row = F.concat(F.lit("("), F.concat_ws(" ", F.lit(name), *t.keys), F.lit(")"))
            lines = rows.select((F.concat_ws(" -> ", row, *(["ret"] if t.out else []))).alias("value"))
        else:
            raise ProgramError(f"print-function: no mode {mode}")
        if path:
            lines.write.mode("overwrite").text(path)
            return []
        return [r[0] for r in lines.limit(n if n is not None else 1000).collect()]
