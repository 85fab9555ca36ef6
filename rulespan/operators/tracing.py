"""What rules did: matches, written rows and unions as event tables; proofs and equality paths over them.

With ``Program(spark, trace=True)``, the matches of every rule in every step are written before they act. Proofs
are of rows without ids, since ids are renamed by later unions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.parser import Lit, ProgramError, Sym, read
from ..plans.rules import atom_frame, evaluate

GIVEN = "given"


@dataclass
class Event:
    step: int
    rule: object
    matches: DataFrame
    staged: dict[str, DataFrame] = field(default_factory=dict)
    edges: DataFrame | None = None


@dataclass
class Proof:
    """A row, the rule that made it, its variables, and the proofs of the rows that it matched."""

    table: str
    row: tuple
    rule: str
    step: int
    bindings: dict = field(default_factory=dict)
    premises: list[Proof] = field(default_factory=list)

    def lines(self, depth: int = 0) -> list[str]:
        out = [f"{'  ' * depth}({' '.join([self.table, *map(str, self.row)])}) by {self.rule} at {self.step}"]
        return out + [line for p in self.premises for line in p.lines(depth + 1)]


class Tracing:
    """Events, proofs and paths."""

    def _union_all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def traced_matches(self) -> DataFrame:
        """``step, rule, bindings``: each match, its variables as JSON."""
        rows = [e.matches.select(F.lit(e.step).alias("step"), F.lit(e.rule.name).alias("rule"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in e.matches.columns if c[0] != "_"] or [F.lit(1).alias("_")])).alias("bindings")) for e in self.events]
        return self._union_all(rows, "step int, rule string, bindings string")

    def traced_writes(self, table: str) -> DataFrame:
        """``step, rule`` and the columns of every row that a rule gave to a table, new or not."""
        t = self.tables[table]
        rows = [e.staged[table].select(F.lit(e.step).alias("step"), F.lit(e.rule.name).alias("rule"), *t.columns) for e in self.events if table in e.staged]
        return self._union_all(rows, f"step int, rule string, {', '.join(f'{c} {t.schema[c].dataType.simpleString()}' for c in t.columns)}")

    def traced_unions(self) -> DataFrame:
        """``step, rule, a, b``: each pair of ids that a rule or command made equal."""
        rows = [e.edges.select(F.lit(e.step).alias("step"), F.lit(e.rule.name if e.rule else GIVEN).alias("rule"), "a", "b") for e in self.events if e.edges is not None]
        rows += [df.select(F.lit(step).alias("step"), F.lit("rebuild").alias("rule"), "a", "b") for step, df in self.rebuilt]
        return self._union_all(rows, "step int, rule string, a long, b long")

    def equality_path(self, x: int, y: int, most: int = 64) -> list[tuple[int, int, str, int]] | None:
        """A shortest chain of unions from id x to id y: ``from, to, rule, step`` each; None if there is none.

        Goes outwards from x by one join a round; what a round reaches is written, and read back along the way.
        """
        if x == y:
            return []
        unions = self.store.keep(self.traced_unions())
        both = unions.unionByName(unions.select("step", "rule", F.col("b").alias("a"), F.col("a").alias("b")))
        seen = self.spark.createDataFrame([(x,)], "a long")
        rounds: list[DataFrame] = []
        front = seen
        for _ in range(most):
            step = both.join(front, "a").join(seen.withColumnRenamed("a", "b"), "b", "left_anti")
            reached = self.store.keep(step.groupBy("b").agg(F.min(F.struct("step", "rule", "a")).alias("via")))
            if not reached.take(1):
                return None
            rounds.append(reached)
            if reached.where(F.col("b") == y).take(1):
                break
            front = reached.select(F.col("b").alias("a"))
            seen = self.store.keep(seen.unionByName(front))
        else:
            return None
        path, at = [], y
        for reached in reversed(rounds):
            via = reached.where(F.col("b") == at).first()["via"]
            path.append((via["a"], at, via["rule"], via["step"]))
            at = via["a"]
        return path[::-1]

    # -- proofs -------------------------------------------------------------------------------

    def prove(self, fact, most: int = 1000) -> Proof:
        """How a row, ``(table value ..)``, came about; raises if it isn't there. ``most`` bounds the rows of the proof."""
        if not self.tracing:
            raise ProgramError("prove needs a program with trace=True")
        fact = read(fact)[0] if isinstance(fact, str) else fact
        t = self.tables[fact[0].name]
        if t.ids or t.boxed or t.kind == "constructor":
            raise ProgramError("prove takes rows without ids")
        values = tuple(x.value for x in fact[1:])
        rows = self.store.read(t)
        for c, v in zip(t.columns, values, strict=False):
            rows = rows.where(F.col(c) == F.lit(v).cast(t.schema[c].dataType))
        row = rows.select(*t.columns).first()
        if row is None:
            raise ProgramError(f"nothing to prove: {fact}")
        self._left = most
        return self._proof(t.name, tuple(row), self.step)

    def _proof(self, name: str, row: tuple, before: int) -> Proof:
        """The earliest event that gave the row; rows that no event gave were given from outside."""
        self._left -= 1
        if self._left < 0:
            raise ProgramError("the proof is longer than its bound")
        t = self.tables[name]
        same = lambda df: reduce(lambda d, cv: d.where(F.col(cv[0]) == F.lit(cv[1]).cast(t.schema[cv[0]].dataType)), zip(t.columns, row, strict=True), df)
        for e in self.events:
            if e.step >= before or name not in e.staged or not same(e.staged[name]).take(1):
                continue
            found = self._match_of(e, t, row)
            if found is None:
                continue
            q = e.rule.query
            value = lambda x, found=found: x.value if isinstance(x, Lit) else found[x.name]
            premises = []
            for a in q.atoms:
                other = self.tables[a.table]
                if not (other.ids or other.boxed):
                    premises.append(self._proof(a.table, tuple(map(value, a.args)), e.step))
            shown = {k: v for k, v in found.items() if k[0] != "_"}
            return Proof(name, row, e.rule.name, e.step, shown, premises)
        return Proof(name, row, GIVEN, 0)

    def _match_of(self, e: Event, t, row: tuple) -> dict | None:
        """The variables of the first match whose actions give the row."""
        from .program import Effects

        sorts = dict(e.rule.query.sorts)
        for a in e.rule.actions:
            effects = Effects()
            self._act([a], e.matches.withColumn("match!", F.to_json(F.struct(*[F.col(f"`{c}`") for c in e.matches.columns]))), effects, sorts, rule=True, keep=["match!"])
            for df in effects.staged.get(t.name, []):
                for c, v in zip(t.columns, row, strict=True):
                    df = df.where(F.col(c) == F.lit(v).cast(t.schema[c].dataType))
                first = df.select("match!").orderBy("match!").first()
                if first:
                    found = e.matches.where(F.to_json(F.struct(*[F.col(f"`{c}`") for c in e.matches.columns])) == first[0]).first()
                    return found.asDict()
        return None

    def check_proof(self, proof: Proof) -> bool:
        """Whether each step holds by itself: the rule, run over the premises alone, gives the row."""
        from .program import Effects

        t = self.tables[proof.table]
        if proof.rule == GIVEN:
            return not proof.premises and bool(reduce(lambda d, cv: d.where(F.col(cv[0]) == F.lit(cv[1]).cast(t.schema[cv[0]].dataType)), zip(t.columns, proof.row, strict=True), self.store.read(t)).take(1))
        rule = next((r for rs in self.rulesets.values() for r in rs if r.name == proof.rule), None)
        if rule is None or len(rule.query.atoms) != len(proof.premises) or any(p.step >= proof.step for p in proof.premises):
            return False
        frames = []
        for a, p in zip(rule.query.atoms, proof.premises, strict=True):
            other = self.tables[a.table]
            if a.table != p.table:
                return False
            schema = [other.schema[c] for c in other.columns]
            rows = self.spark.createDataFrame([p.row], type(other.schema)(schema)) if schema else self.spark.range(1).select()
            frames.append(atom_frame(a, rows, other.columns))
        effects = Effects()
        matches = evaluate(rule.query, frames, one_row=self.spark.range(1).select())
        self._act(rule.actions, matches, effects, dict(rule.query.sorts), rule=True)
        for df in effects.staged.get(proof.table, []):
            for c, v in zip(t.columns, proof.row, strict=True):
                df = df.where(F.col(c) == F.lit(v).cast(t.schema[c].dataType))
            if df.take(1):
                return all(map(self.check_proof, proof.premises))
        return False


def symbols(x) -> set[str]:
    """Names in an expression."""
    return {x.name} if isinstance(x, Sym) else set().union(*map(symbols, x)) if isinstance(x, list) else set()
