"""Rule bodies as joins, and their expressions as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import containers, scalar  # noqa: F401
from .multiway import generic, reduced
from .parser import Lit, ProgramError, Sym
from .sorts import spark_type


@dataclass
class Atom:
    table: str
    args: list  # Sym or Lit, the value last


@dataclass
class Prim:
    name: str
    args: list
    out: Sym
    sort: str = "?"  # of the result


@dataclass
class Query:
    atoms: list[Atom] = field(default_factory=list)
    prims: list[Prim] = field(default_factory=list)
    equal: list[tuple] = field(default_factory=list)
    sorts: dict[str, str] = field(default_factory=dict)


def literal(x: Lit) -> Column:
    return F.lit(x.value).cast("long") if x.sort == "i64" else F.lit(x.value)


class Compiler:
    """Turns facts into a query over declared tables."""

    def __init__(self, tables: dict, globals_: dict[str, str]):
        self.tables, self.globals, self.fresh = tables, globals_, 0

    def new(self) -> Sym:
        self.fresh += 1
        return Sym(f"_{self.fresh}")

    def flat(self, x, q: Query):
        """The variable or literal that stands for an expression; atoms go to ``q``."""
        if isinstance(x, Lit):
            return x
        if isinstance(x, Sym):
            if x.name == "_":
                return self.new()
            if x.name in self.globals:
                v = Sym(f"{x.name}!")
                if not any(a.table == x.name for a in q.atoms):
                    q.atoms.append(Atom(x.name, [v]))
                return v
            return x
        if not x or not isinstance(x[0], Sym):
            raise ProgramError(f"not an expression: {x}")
        name, args = x[0].name, [self.flat(a, q) for a in x[1:]]
        if name in self.tables:
            t = self.tables[name]
            if len(args) != len(t.args):
                raise ProgramError(f"{name} takes {len(t.args)} arguments, not {len(args)}")
            out = self.new()
            q.atoms.append(Atom(name, [*args, *([out] if t.out else [])]))
            return out
        if name not in scalar.TABLE and name not in containers.EMPTY:
            raise ProgramError(f"unbound function {name}")
        q.prims.append(Prim(name, args, out := self.new()))
        return out

    def query(self, facts: list) -> Query:
        q = Query()
        for f in facts:
            if isinstance(f, list) and f and f[0] == Sym("="):
                sides = [self.flat(x, q) for x in f[1:]]
                q.equal += [(sides[0], s) for s in sides[1:]]
            else:
                self.flat(f, q)
        self.substitute(q)
        self.infer(q)
        return q

    def substitute(self, q: Query) -> None:
        """Equal variables become one; a variable equal to a literal becomes it where an atom has it."""
        while q.equal:
            a, b = q.equal.pop()
            if a == b:
                continue
            if isinstance(a, Lit) and isinstance(b, Lit):
                q.prims.append(Prim("bool-value-eq", [a, b], self.new()))
                continue
            old, new = (a, b) if isinstance(a, Sym) and (a.name[0] == "_" or isinstance(b, Lit)) else (b, a)
            if isinstance(old, Lit):
                old, new = new, old
            swap = lambda x, old=old, new=new: new if x == old else x
            for atom in q.atoms:
                atom.args = [swap(x) for x in atom.args]
            for p in q.prims:
                p.args, p.out = [swap(x) for x in p.args], swap(p.out)
            q.equal = [(swap(x), swap(y)) for x, y in q.equal]
            if isinstance(old, Sym) and old.name[0] != "_":
                q.prims.append(Prim("value", [new], old))

    def infer(self, q: Query) -> None:
        """Sorts of variables; every variable must come from an atom or from a primitive over such."""
        for a in q.atoms:
            t = self.tables[a.table]
            for x, sort in zip(a.args, [*t.args, *([t.out] if t.out else [])], strict=True):
                if isinstance(x, Lit):
                    if x.sort != sort:
                        raise ProgramError(f"{a.table}: {x.value!r} is no {sort}")
                elif q.sorts.setdefault(x.name, sort) != sort:
                    raise ProgramError(f"{x.name} is {q.sorts[x.name]} and {sort}")
        waiting = list(q.prims)
        ordered = []
        while waiting:
            ready = [p for p in waiting if all(isinstance(x, Lit) or x.name in q.sorts for x in p.args)]
            if not ready:
                raise ProgramError(f"variable {next(x.name for p in waiting for x in p.args if isinstance(x, Sym) and x.name not in q.sorts)} is ungrounded")
            for p in ready:
                p.sort = sort = self.result(p, q)
                if isinstance(p.out, Sym):
                    known = scalar.unified(q.sorts.get(p.out.name, "?"), sort)
                    if known is None:
                        raise ProgramError(f"{p.out.name} is {q.sorts[p.out.name]} and {sort}")
                    q.sorts[p.out.name] = known
                ordered.append(p)
                waiting.remove(p)
        q.prims = ordered

    def result(self, p: Prim, q: Query) -> str:
        sorts = [x.sort if isinstance(x, Lit) else q.sorts[x.name] for x in p.args]
        if p.name == "value":
            return sorts[0]
        if p.name == "bool-value-eq":
            return "Unit"
        if p.name in containers.EMPTY and not sorts:
            return scalar.unified(q.sorts.get(p.out.name, "?") if isinstance(p.out, Sym) else "?", containers.EMPTY[p.name]) or containers.EMPTY[p.name]
        if found := scalar.find(p.name, sorts):
            return found[1]
        raise ProgramError(f"{p.name}: no definition for {' '.join(sorts)}")


def empty(sort: str) -> Column:
    """An empty container; one of unknown sort fits where it is used."""
    return F.array() if "?" in sort else F.array().cast(spark_type(sort))


def applied(name: str, cols: list[Column], sorts: list[str]) -> tuple[Column, str] | None:
    """A primitive on columns, and its result's sort; empty containers among them get the sort they need."""
    found = scalar.resolve(name, sorts)
    if not found:
        return None
    f, sort, filled = found
    return f(*[c.cast(spark_type(w)) if "?" in s and "?" not in w else c for c, s, w in zip(cols, sorts, filled, strict=True)]), sort


def prim_column(p: Prim, sorts: dict[str, str]) -> Column:
    cols = [literal(x) if isinstance(x, Lit) else F.col(f"`{x.name}`") for x in p.args]
    if p.name == "value":
        return cols[0]
    if p.name == "bool-value-eq":
        return scalar._true(cols[0] == cols[1])
    if p.name in containers.EMPTY and not cols:
        return empty(sorts.get(p.out.name, "?"))
    return applied(p.name, cols, [x.sort if isinstance(x, Lit) else sorts[x.name] for x in p.args])[0]


def atom_frame(atom: Atom, df: DataFrame, columns: list[str]) -> DataFrame:
    """A table's rows with variables for columns; constants and repeated variables become filters."""
    keep: dict[str, str] = {}
    for c, x in zip(columns, atom.args, strict=True):
        if isinstance(x, Lit):
            df = df.where(F.col(c) == literal(x))
        elif x.name in keep:
            df = df.where(F.col(c) == F.col(keep[x.name]))
        else:
            keep[x.name] = c
    return df.select(*[F.col(c).alias(v) for v, c in keep.items()], *([] if keep else [F.lit(True).alias(f"_unit_{id(atom)}")]))


#: Rows of a cross product that a rule may ask for; a larger one is refused.
MOST_PRODUCT = 10**12
BINARY, GENERIC, REDUCED = "binary", "generic", "reduced"


def groups(q: Query, frames: list[DataFrame]) -> list[set[int]]:
    """Atoms that hang together by variables, primitives between them included."""
    names = [{c for c in f.columns if not c.startswith("_unit_")} for f in frames]
    sets = [({k}, set(n)) for k, n in enumerate(names)]
    sets += [(set(), {x.name for x in [*p.args, p.out] if isinstance(x, Sym)}) for p in q.prims]
    out: list[tuple[set[int], set[str]]] = []
    for atoms, held in sets:
        apart = [o for o in out if not o[1] & held]
        near = [o for o in out if o[1] & held]
        out = [*apart, (atoms.union(*(o[0] for o in near)), held.union(*(o[1] for o in near)))]
    return [o[0] for o in out if o[0]]


def evaluate(q: Query, frames: list[DataFrame], first: int | None = None, one_row: DataFrame | None = None, needed: set[str] | None = None, sizes: list[int] | None = None, strategy: str = BINARY) -> DataFrame:
    """Joins all atoms, the one numbered ``first`` (or the smallest) first and then always one that shares a variable if any does.

    With ``needed``, parts of the query that share no variable with the rest and bind none that is needed are only
    asked whether they hold. ``sizes`` (rows of each frame's table at most) order and bound cross products.
    ``strategy`` names another way to join (see :mod:`multiway`); ``reduced`` is for acyclic queries, others stay as they are.
    """
    if first is None:
        first = min(range(len(frames)), key=lambda k: sizes[k]) if sizes and frames else 0
    if needed is not None and len(frames) > 1 and len(parts := groups(q, frames)) > 1:
        whole: DataFrame | None = None
        for atoms in sorted(parts, key=lambda a: (first not in a, min(a))):
            inner = sorted(atoms)
            held = {c for k in inner for c in frames[k].columns}
            prims, more = [], True
            while more:
                more = False
                for p in q.prims:
                    if p not in prims and all(isinstance(x, Lit) or x.name in held for x in p.args) and any(isinstance(x, Sym) for x in [*p.args, p.out]):
                        prims.append(p)
                        held |= {p.out.name} if isinstance(p.out, Sym) else set()
                        more = True
            # Primitives over literals only are in every part: they hold or not for all.
            prims = [p for p in q.prims if p in prims or all(isinstance(x, Lit) for x in p.args)]
            sub = Query([q.atoms[k] for k in inner], prims, [], q.sorts)
            rows = evaluate(sub, [frames[k] for k in inner], inner.index(first) if first in inner else None, sizes=[sizes[k] for k in inner] if sizes else None, strategy=strategy)
            new = [c for c in rows.columns if c in needed and (whole is None or c not in whole.columns)]
            rows = rows.select(*[F.col(f"`{c}`") for c in new]) if new else rows.limit(1).select(F.lit(True).alias(f"_held_{inner[0]}"))
            whole = rows if whole is None else whole.join(rows)
        if sizes is not None:
            most = 1
            for atoms in parts:
                if needed & {c for k in atoms for c in frames[k].columns}:
                    most *= max(1, max(sizes[k] for k in atoms))
            if most > MOST_PRODUCT:
                raise ProgramError(f"a cross product of up to {most} rows")
        return whole
    if strategy == REDUCED and len(frames) > 1:
        frames = reduced(frames) or frames
    left = list(range(len(q.atoms)))
    prims = list(q.prims)
    done: DataFrame | None = None
    have: set[str] = set()
    most = 1

    def apply(df: DataFrame) -> DataFrame:
        for p in list(prims):
            if all(isinstance(x, Lit) or x.name in have for x in p.args):
                prims.remove(p)
                c = prim_column(p, q.sorts)
                if isinstance(p.out, Lit):
                    df = df.where(c == literal(p.out))
                elif p.out.name in have:
                    df = df.where(c == F.col(f"`{p.out.name}`"))
                elif p.sort in scalar.COSTLY and p.name != "value":
                    # No filter moves below a generator over what it makes, where it would find the value again for each use.
                    df = df.select("*", F.explode(F.array_compact(F.array(c))).alias(p.out.name))
                    have.add(p.out.name)
                else:
                    df = df.withColumn(p.out.name, c).where(F.col(f"`{p.out.name}`").isNotNull())
                    have.add(p.out.name)
        return df

    if strategy == GENERIC and len(frames) > 1:
        done, left = generic(frames), []
        have |= set(done.columns)
        return apply(done)
    while left:
        near = [i for i in left if have & set(frames[i].columns)] or left
        k = first if done is None else min(near, key=lambda i: sizes[i]) if sizes else near[0]
        left.remove(k)
        shared = [c for c in frames[k].columns if c in have]
        if sizes:
            most = sizes[k] if done is None else max(most, sizes[k]) if shared else most * max(1, sizes[k])
            if most > MOST_PRODUCT:
                raise ProgramError(f"a cross product of up to {most} rows")
        done = frames[k] if done is None else done.join(frames[k], shared) if shared else done.join(frames[k])
        have |= set(frames[k].columns)
        done = apply(done)
    return apply(one_row) if done is None else done
