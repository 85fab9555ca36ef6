"""Programs: tables with keys and merges, rules run to a fixpoint, equality, extraction.

All rules of a step match the same snapshot; their effects are staged, deletions applied before
insertions, rows of one key merged, and ids that became equal replaced by the least of them until
nothing collides. A row keeps its step number while its value stays, and a rule joins only what
changed since it last ran (semi-naive).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..plans.parser import Lit, ProgramError, Sym, options, read
from ..plans.rules import BINARY, Compiler, Query, applied, atom_frame, empty, evaluate, literal
from ..functions import containers
from ..plans.sorts import BASE
from . import store
from .components import connected_components
from .extraction import Extraction
from .function_values import FunctionValues, fn_sort, moved_functions, moved_values
from .inspection import Inspection
from .persistence import DECLARE, Persistence
from .schedulers import LimitReached, Scheduler
from .store import Store, Table
from .tracing import Event, Tracing, symbols

LATTICE = {"min": F.min, "max": F.max, "or": F.bool_or, "and": F.bool_and}


@dataclass
class Rule:
    name: str
    query: Query
    actions: list
    naive: bool = False
    last: int = 0
    matches: int = 0
    fired: bool = False
    runs: int = 0
    seconds: float = 0.0
    host: Callable | None = None  # takes the matches and gives rows by table, in place of actions


@dataclass
class Effects:
    staged: dict[str, list[DataFrame]] = field(default_factory=dict)
    removed: dict[str, list[DataFrame]] = field(default_factory=dict)
    hidden: dict[str, list[DataFrame]] = field(default_factory=dict)
    edges: list[DataFrame] = field(default_factory=list)

    def add(self, other: Effects) -> None:
        for mine, theirs in ((self.staged, other.staged), (self.removed, other.removed), (self.hidden, other.hidden)):
            for name, dfs in theirs.items():
                mine.setdefault(name, []).extend(dfs)
        self.edges += other.edges


@dataclass
class Report:
    updated: bool = False
    can_stop: bool = True

    def add(self, other: Report) -> Report:
        return Report(self.updated or other.updated, self.can_stop and other.can_stop)


class Program(FunctionValues, Extraction, Inspection, Persistence, Tracing):
    """A database of declared tables and rules.

    ``naive`` joins all rows in every step; ``trace`` keeps what rules did (see :class:`Tracing`); ``stats`` counts
    matches, at the price of writing them once. ``most_steps`` and ``most_rows`` bound a run: a step beyond them
    is undone and raises :class:`LimitReached`. ``strategy`` is how the atoms of a body are joined: "binary", "generic"
    (a variable at a time, for cyclic patterns) or "reduced" (semi-joins first, for acyclic ones).
    """

    def __init__(self, spark: SparkSession, naive: bool = False, trace: bool = False, stats: bool = False, most_steps: int | None = None, most_rows: int | None = None, strategy: str = BINARY):
        self.strategy = strategy
        self.spark, self.naive, self.tracing, self.stats = spark, naive, trace, stats
        self.most_steps, self.most_rows, self.steps_run = most_steps, most_rows, 0
        self.events: list[Event] = []
        self.rebuilt: list[tuple[int, DataFrame]] = []  # with trace: pairs that became equal since their arguments did
        self.declared: list = []  # commands that declare something, in order
        self.macros: dict[str, Callable[[list], object]] = {}  # name -> rewrites an expression that begins with it
        self.command_macros: list[Callable[[list], list]] = []  # each rewrites a command to commands
        self.host_prims: dict[str, list[tuple[list[str], str, Callable, str]]] = {}
        self.waiting: dict[int, DataFrame] = {}  # matches that a scheduler holds back, by rule
        self.resumed: dict = {}
        self.store = Store(spark)
        self.sorts: dict[str, str] = {}  # name -> what it stands for; itself for ids
        self.tables: dict[str, Table] = {}
        self.globals: dict[str, str] = {}
        self.rulesets: dict[str, list[Rule]] = {"": []}
        self.combined: dict[str, list[str]] = {}
        self.step = 1
        self.stack: list[tuple] = []
        self.outputs: list[str] = []
        self.commands = {}
        self.fn_uses: set[tuple[str, tuple[str, ...]]] = set()  # names given to unstable-fn, and the sorts given with them

    # -- declarations -------------------------------------------------------------------------

    def sort(self, x) -> str:
        if isinstance(x, list):
            if x[0].name == "UnstableFn":
                return fn_sort([self.sort(a) for a in x[1]], self.sort(x[2]))
            return f"{x[0].name}<{','.join(self.sort(a) for a in x[1:])}>"
        name = x.name if isinstance(x, Sym) else x
        if name in BASE or name == "BigRat" or "<" in name:
            return name
        if name not in self.sorts:
            raise ProgramError(f"unbound sort {name}")
        return self.sorts[name]

    def is_id(self, sort: str) -> bool:
        return self.sorts.get(sort) == sort

    def declare_sort(self, name: str, of: list | None = None) -> None:
        self._new_name(name)
        self.sorts[name] = self.sort(of) if of else name

    def _new_name(self, name: str) -> None:
        if name in self.tables or name in self.sorts or name in BASE:
            raise ProgramError(f"{name} is declared already")

    def declare(self, name: str, kind: str, args: list, out=None, merge=None, cost: int = 1, extractable: bool = True) -> Table:
        self._new_name(name)
        sorts = [self.sort(a) for a in args]
        result = self.sort(out) if out is not None else None
        if kind == "constructor" and not self.is_id(result):
            raise ProgramError(f"{name}: a constructor's result must be a declared sort")
        if kind == "function" and merge is None:
            raise ProgramError(f"{name}: :merge or :no-merge is missing")
        t = Table(name, kind, sorts, None if result == "Unit" else result, merge, cost, extractable)
        self._find_ids(t)
        self.tables[name] = t
        return t

    def _find_ids(self, t: Table) -> None:
        sorts = [*t.args, *([t.out] if t.out else [])]
        t.ids = [i for i, s in enumerate(sorts) if self.is_id(s)]
        t.boxed = {i: s for i, s in enumerate(sorts) if "<" in s and (s.startswith("UnstableFn<") or containers.id_elements(F.lit(None), s, self.is_id) is not None)}

    def relation(self, name: str, args: list) -> Table:
        return self.declare(name, "relation", args)

    def function(self, name: str, args: list, out: str, merge: str | None = None) -> Table:
        return self.declare(name, "function", args, out, read(merge)[0] if merge else "no-merge")

    def constructor(self, name: str, args: list, out: str, cost: int = 1) -> Table:
        return self.declare(name, "constructor", args, out, "union", cost)

    # -- facts --------------------------------------------------------------------------------

    def load(self, name: str, df: DataFrame, nulls: str = "drop") -> int:
        """Adds rows: keys, then the value of a function. How many rows the table has more is returned.

        There are no nulls in tables: rows with one are left out, or with ``nulls="error"`` make the whole load fail
        before anything is changed.
        """
        t = self.tables[name]
        n = len(t.args) + (t.kind == "function" and t.out is not None)
        if len(df.columns) != n:
            raise ProgramError(f"{name} takes {n} columns, not {len(df.columns)}")
        cols = [F.col(f"`{c}`").cast(t.schema[k].dataType).alias(k) for c, k in zip(df.columns, t.columns, strict=False)]
        rows, before = df.select(*cols), t.rows
        if nulls == "error" and cols:
            rows = self.store.keep(rows)
            if rows.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in rows.columns])).take(1):
                raise ProgramError(f"{name}: a row with a null")
        rows = rows.dropna()
        if t.kind == "constructor":
            rows = rows.distinct()
            old = self.store.read(t)
            rows = rows.join(old.select(*t.keys), t.keys, "left_anti") if t.keys else rows
            rows = rows.withColumn("ret", self._mint(t, [F.col(k) for k in t.keys]))
        self._apply(Effects(staged={name: [rows.withColumn("sub", F.lit(False))]}))
        return self.tables[name].rows - before

    def _mint(self, t: Table, keys: list[Column]) -> Column:
        """An id for a new row: a hash of constructor, keys and step, so equal terms of a step are one."""
        return F.xxhash64(F.lit(t.name), *keys, F.lit(self.step))

    # -- programs -----------------------------------------------------------------------------

    def run(self, text: str) -> list[str]:
        """Runs a program and returns what it printed."""
        before, facts = len(self.outputs), []
        for command in [*read(text), None]:
            if command is not None and self._is_ground(command):
                facts.append(command)
                continue
            if facts:
                self._add_ground(facts)
                facts = []
            if command is not None:
                self.command(command)
        return self.outputs[before:]

    def _is_ground(self, c) -> bool:
        """Whether a command is a relation's row of literals of the right sorts: a run of them is added at once."""
        if self.macros or self.command_macros or not isinstance(c, list) or not c or not isinstance(c[0], Sym) or c[0].name in self.commands:
            return False
        t = self.tables.get(c[0].name)
        return t is not None and t.kind == "relation" and bool(t.args) and len(c) - 1 == len(t.args) and all(isinstance(a, Lit) and a.sort == s for a, s in zip(c[1:], t.args, strict=True))

    def _add_ground(self, facts: list) -> None:
        rows: dict[str, list[tuple]] = {}
        for f in facts:
            rows.setdefault(f[0].name, []).append(tuple(a.value for a in f[1:]))
        staged = {}
        for name, values in rows.items():
            t = self.tables[name]
            frame = self.spark.createDataFrame(values, T.StructType([t.schema[k] for k in t.keys]))
            staged[name] = [frame.withColumn("sub", F.lit(False))]
        self._apply(Effects(staged=staged))

    def expanded(self, x):
        """An expression with all macros in it applied, outer ones first."""
        for _ in range(1000):
            if isinstance(x, list) and x and isinstance(x[0], Sym) and x[0].name in self.macros:
                x = self.macros[x[0].name](x)
            else:
                return [self.expanded(a) for a in x] if isinstance(x, list) else x
        raise ProgramError("a macro doesn't end")

    def command(self, c: list) -> None:
        if not isinstance(c, list) or not c or not isinstance(c[0], Sym):
            raise ProgramError(f"not a command: {c}")
        many = [self.expanded(c)] if self.macros else [c]
        for macro in self.command_macros:
            many = [d for m in many for d in macro(m)]
        for c in many:
            self._command(c)

    def _command(self, c: list) -> None:
        # The words of commands, and of their options below, are those of the language.
        head = c[0].name
        args, named = options(c[1:])
        if head in DECLARE and head not in self.commands:
            self.declared.append(c)
        if head in self.commands:
            self.commands[head](self, args)
        elif head == "sort":
            self.declare_sort(args[0].name, args[1] if len(args) > 1 else None)
        elif head in ("datatype", "datatype*"):
            groups = [args] if head == "datatype" else args
            for g in groups:
                if g[0] == Sym("sort"):
                    self.declare_sort(g[1].name, g[2])
                else:
                    self.declare_sort(g[0].name)
            for g in groups:
                for v in g[1:] if g[0] != Sym("sort") else []:
                    fields, opt = options(v[1:])
                    self.declare(v[0].name, "constructor", fields, g[0], "union", opt.get("cost", Lit(1)).value)
        elif head == "constructor":
            self.declare(args[0].name, "constructor", args[1], args[2], "union", named["cost"].value if "cost" in named else 1, "unextractable" not in named)
        elif head == "function":
            if ("merge" in named) == ("no-merge" in named):
                raise ProgramError(f"{args[0]}: one of :merge and :no-merge is needed")
            self.declare(args[0].name, "function", args[1], args[2], named.get("merge", "no-merge"), 1, "unextractable" not in named)
        elif head == "relation":
            self.declare(args[0].name, "relation", args[1])
        elif head == "ruleset":
            self.rulesets[args[0].name] = []
        elif head == "unstable-combined-ruleset":
            self.combined[args[0].name] = [a.name for a in args[1:]]
        elif head == "rule":
            self.rule(args[0], args[1], named)
        elif head in ("rewrite", "birewrite"):
            both = head == "birewrite"
            name = named["name"].value if "name" in named else None
            self.rewrite(args[0], args[1], {**named, **({"name": Lit(f"{name}=>")} if both and name else {})})
            if both:
                self.rewrite(args[1], args[0], {**named, **({"name": Lit(f"{name}<=")} if name else {})})
        elif head == "let":
            self.let(args[0].name, args[1])
        elif head == "run":
            n = args.pop().value if args and isinstance(args[-1], Lit) else 1
            until = [named["until"]] if "until" in named else None
            self.schedule([Sym("repeat"), Lit(n), [Sym("run"), *args, *([Sym(":until"), until[0]] if until else [])]])
        elif head == "run-schedule":
            self.schedule([Sym("seq"), *args])
        elif head == "check":
            if not self.check(args):
                raise ProgramError(f"check failed: {args}")
        elif head == "fail":
            state = self._state()
            try:
                self.command(args[0])
            except (ProgramError, PySparkException) as e:
                # What the command had done by then is undone. Failures that aren't of the program go on.
                if not isinstance(e, ProgramError) and "USER_RAISED_EXCEPTION" not in str(e):
                    raise
                self._restore(state)
                return
            raise ProgramError(f"command was to fail: {args[0]}")
        elif head == "extract":
            n = args[1].value if len(args) > 1 else None
            found = self.extract(args[0], n)
            self.outputs += [t for _, t in found]
        elif head == "print-size":
            names = [args[0].name] if args else sorted(n for n in self.tables if n not in self.globals)
            self.outputs += [str(self.size(n)) if args else f"{n}: {self.size(n)}" for n in names]
        elif head == "print-function":
            path = named["file"].value if "file" in named else None
            mode = getattr(named.get("mode"), "name", "default")
            self.outputs += self.print_function(args[0].name, args[1].value if len(args) > 1 else None, path, mode)
        elif head == "print-stats":
            self.outputs += self.stats_lines()
        elif head == "prove":
            if not self.check(args):
                raise ProgramError(f"nothing to prove: {args}")
            self.outputs += [line for f in args for line in self.prove(f).lines()]
        elif head == "prove-exists":
            row = self.rows(args[0].name).first()
            if row is None:
                raise ProgramError(f"{args[0]} is empty")
            self.outputs += self.prove([args[0], *map(Lit, row)]).lines()
        elif head == "push":
            for _ in range(args[0].value if args else 1):
                self.stack.append(self._state())
        elif head == "pop":
            for _ in range(args[0].value if args else 1):
                if not self.stack:
                    raise ProgramError("pop without push")
                self._restore(self.stack.pop())
        elif head == "input":
            from ..sources.files import input_file

            input_file(self, args[0].name, args[1].value)
        elif head == "output":
            from ..sources.files import output_terms

            output_terms(self, args[0].value, args[1:])
        elif head == "include":
            from ..sources.files import read_text

            self.run(read_text(self.spark, args[0].value))
        else:
            self.act([c])

    def close(self) -> None:
        """Deletes everything that the program has written, its tables too."""
        self.store.close()

    def _state(self) -> tuple:
        rules = {k: list(v) for k, v in self.rulesets.items()}
        marks = {id(r): (r.last, r.fired) for v in rules.values() for r in v}
        return {k: t.copy() for k, t in self.tables.items()}, dict(self.sorts), dict(self.globals), rules, marks, dict(self.combined), list(self.declared), dict(self.waiting)

    def _restore(self, state: tuple) -> None:
        self.tables, self.sorts, self.globals, self.rulesets, marks, self.combined, self.declared, self.waiting = state
        for v in self.rulesets.values():
            for r in v:
                r.last, r.fired = marks[id(r)]

    # -- rules --------------------------------------------------------------------------------

    def compiler(self) -> Compiler:
        return Compiler(self.tables, self.globals)

    def rule(self, facts: list, actions: list, named: dict | None = None) -> Rule:
        named = named or {}
        rs = named["ruleset"].name if "ruleset" in named else ""
        if rs in self.combined:
            raise ProgramError(f"{rs} is a combined ruleset")
        if rs not in self.rulesets:
            raise ProgramError(f"no ruleset {rs}")
        compiler = self.compiler()
        q = compiler.query(facts)
        name = named["name"].value if "name" in named else f"rule{sum(map(len, self.rulesets.values()))}"
        r = Rule(name, q, actions, "naive" in named)
        self._validate(actions, set(q.sorts), r.naive)
        self.rulesets[rs].append(r)
        return r

    def rewrite(self, left, right, named: dict) -> None:
        v = Sym("rewritten!")
        facts = [[Sym("="), v, left], *(named.get("when") or [])]
        actions = [[Sym("union"), v, right], *([[Sym("subsume"), left]] if "subsume" in named else [])]
        self.rule(facts, actions, named)

    def host_rule(self, facts: str, f: Callable[[DataFrame], dict[str, DataFrame]], ruleset: str = "", name: str | None = None, naive: bool = False) -> Rule:
        """A rule whose head is a function: it takes the matches, a column for each variable, and gives rows by table.

        Rows have a table's keys and then its value, in order, as for :meth:`load`; a constructor's have its keys only.
        """
        rule = self.rule(read(facts), [], {"ruleset": Sym(ruleset)} if ruleset else {})
        rule.host, rule.naive, rule.name = f, naive, name or rule.name
        return rule

    def primitive(self, name: str, args: list[str], result: str, f: Callable, context: str = "pure") -> None:
        """A function of one's own.

        ``pure``: ``f(*columns)`` gives a column, null where it has no result; usable anywhere, in all programs of the
        process. Others take ``f(program, df, columns, effects)`` and give ``df, column``: ``write`` may add effects
        and is for actions; ``read`` and ``full`` see the tables, so they are for commands and ``:naive`` rules.
        """
        if context not in ("pure", "write", "read", "full"):
            raise ProgramError(f"no context {context}")
        sorts = [self.sort(a) for a in args]
        if context == "pure":
            scalar.define(name, " ".join(sorts), self.sort(result), f)
        else:
            self.host_prims.setdefault(name, []).append((sorts, self.sort(result), f, context))

    def add_ruleset(self, name: str) -> None:
        self.command([Sym("ruleset"), Sym(name)])

    def add_sort(self, name: str, of: str | None = None) -> None:
        self.command([Sym("sort"), Sym(name), *(read(of) if of else [])])

    def add_rule(self, facts: str, actions: str, ruleset: str = "", name: str | None = None) -> None:
        named = [*([Sym(":ruleset"), Sym(ruleset)] if ruleset else []), *([Sym(":name"), Lit(name)] if name else [])]
        self.command([Sym("rule"), read(facts), read(actions), *named])

    def _validate(self, actions: list, bound: set[str], naive: bool = False) -> None:
        """Static checks of a rule's head."""

        def see(x) -> None:
            if isinstance(x, Sym):
                if x.name not in bound and x.name not in self.globals:
                    raise ProgramError(f"unbound variable {x.name}")
            elif isinstance(x, list):
                name = x[0].name
                t = self.tables.get(name)
                if t and t.kind == "function" and name not in self.globals:
                    raise ProgramError(f"{name}: functions can't be looked up in rule actions")
                if not naive and any(p[3] in ("read", "full") for p in self.host_prims.get(name, [])):
                    raise ProgramError(f"{name} sees tables: the rule must be :naive")
                if not t and name not in scalar.TABLE and name not in containers.EMPTY and name not in self.SPECIAL and name not in self.host_prims:
                    raise ProgramError(f"unbound function {name}")
                if t and len(x) - 1 != len(t.args):
                    raise ProgramError(f"{name} takes {len(t.args)} arguments, not {len(x) - 1}")
                for a in x[1:]:
                    see(a)

        for a in actions:
            head = a[0].name if isinstance(a, list) else None
            if head == "let":
                see(a[2])
                bound.add(a[1].name)
            elif head == "set":
                t = self.tables.get(a[1][0].name)
                if not t or t.kind == "constructor":
                    raise ProgramError(f"can't set {a[1][0].name}")
                for x in [*a[1][1:], a[2]]:
                    see(x)
            elif head in ("delete", "subsume"):
                t = self.tables.get(a[1][0].name)
                if not t or head == "subsume" and t.kind == "function":
                    raise ProgramError(f"can't {head} {a[1][0].name}")
                for x in a[1][1:]:
                    see(x)
            elif head in ("union", "panic"):
                for x in a[1:]:
                    see(x)
            else:
                see(a)

    def members(self, name: str) -> list[Rule]:
        if name in self.combined:
            return [r for m in self.combined[name] for r in self.members(m)]
        if name not in self.rulesets:
            raise ProgramError(f"no ruleset {name}")
        return self.rulesets[name]

    # -- schedules ----------------------------------------------------------------------------

    def schedule(self, s) -> Report:
        if isinstance(s, Sym):
            return self.run_step(s.name)
        head, rest = s[0].name, s[1:]
        if head == "run":
            args, named = options(rest)
            if "until" in named and self.check([named["until"]]):
                return Report()
            return self.run_step(args[0].name if args else "")
        if head == "seq":
            return reduce(Report.add, [self.schedule(x) for x in rest], Report())
        if head == "repeat":
            total = Report()
            for _ in range(rest[0].value):
                r = self.schedule([Sym("seq"), *rest[1:]])
                total = total.add(r)
                if not r.updated and r.can_stop:
                    break
            return total
        if head == "saturate":
            total = Report()
            while (r := self.schedule([Sym("seq"), *rest])).updated:
                total = total.add(r)
            return total
        raise ProgramError(f"no schedule {head}")

    def saturate(self, ruleset: str = "") -> int:
        """Steps until nothing changes; returns how many."""
        n = 1
        while self.run_step(ruleset).updated:
            n += 1
        return n

    def run_step(self, ruleset: str = "", scheduler: Scheduler | None = None, without: dict[str, DataFrame] | None = None) -> Report:
        """One step of a ruleset: all rules match the same snapshot, then all effects are applied.

        ``without`` names, by rule, values of some of its variables that are known to bring nothing: matches that have them
        are left out, now and for good. It is trusted, not checked.
        """
        effects, now, state = Effects(), self.step, self._state()
        if self.most_steps is not None and self.steps_run >= self.most_steps:
            raise LimitReached(f"more than {self.most_steps} steps")
        rules, events = self.members(ruleset), []
        for r in rules:
            began = time.time()
            matches = self._matches(r)
            r.last = now
            if matches is not None and without and r.name in without:
                known = without[r.name]
                unused = [c for c in known.columns if c not in matches.columns]
                if unused:
                    raise ProgramError(f"{r.name} has no use for {' '.join(unused)}")
                matches = matches.join(known, known.columns, "left_anti")
            if scheduler:
                matches = self._scheduled(r, matches, scheduler)
            if matches is not None:
                if self.stats or self.tracing:
                    matches = self.store.keep(matches)
                    r.matches += matches.count()
                own = Effects()
                if r.host:
                    self._host(r, matches, own)
                else:
                    self._act(r.actions, matches, own, dict(r.query.sorts), rule=True)
                if self.tracing:
                    events.append(self._event(now, r, matches, own))
                effects.add(own)
            r.runs, r.seconds = r.runs + 1, r.seconds + time.time() - began
        updated = self._apply(effects)
        self.steps_run += 1
        if self.most_rows is not None and (most := max((t.rows for t in self.tables.values()), default=0)) > self.most_rows:
            self._restore(state)
            raise LimitReached(f"a table of {most} rows, more than {self.most_rows}")
        self.events += events
        return Report(updated=updated, can_stop=scheduler.can_stop(rules) if scheduler else True)

    def saturate_with(self, scheduler: Scheduler, ruleset: str = "") -> int:
        """Steps under a scheduler until nothing changes and nothing is held back; returns how many."""
        n = 0
        while True:
            n += 1
            report = self.run_step(ruleset, scheduler)
            if not report.updated and report.can_stop:
                return n

    def _scheduled(self, r: Rule, matches: DataFrame | None, scheduler: Scheduler) -> DataFrame | None:
        held = self.waiting.pop(id(r), None)
        offered = matches if held is None else held if matches is None else matches.unionByName(held)
        if offered is None:
            return None
        now, later = scheduler.choose(r, self.store.keep(offered) if offered.columns else offered)
        if later is not None:
            self.waiting[id(r)] = self.store.keep(later)
        return now

    def _host(self, r: Rule, matches: DataFrame, effects: Effects) -> None:
        shown = matches.select(*[c for c in matches.columns if c[0] != "_" and not c.endswith("!")])
        for name, df in (r.host(shown) or {}).items():
            t = self.tables[name]
            own = t.keys if t.kind == "constructor" else t.columns
            rows = df.select(*[F.col(f"`{c}`").cast(t.schema[k].dataType).alias(k) for c, k in zip(df.columns, own, strict=True)]).dropna()
            if t.kind == "constructor":
                self._call(rows.distinct(), t, [F.col(k) for k in t.keys], effects)
            else:
                effects.staged.setdefault(name, []).append(rows.withColumn("sub", F.lit(False)))

    def _event(self, now: int, r: Rule, matches: DataFrame, effects: Effects) -> Event:
        staged = {n: self.store.keep(reduce(DataFrame.unionByName, dfs)) for n, dfs in effects.staged.items()}
        edges = self.store.keep(reduce(DataFrame.unionByName, effects.edges)) if effects.edges else None
        return Event(now, r, matches, staged, edges)

    def stats_lines(self) -> list[str]:
        """Of each rule: steps it was searched in, matches (counted with ``stats`` or ``trace`` only), seconds to plan and count them."""
        counted = self.stats or self.tracing
        return [f"{r.name}: {r.runs} runs, {f'{r.matches} matches, ' if counted else ''}{r.seconds:.3f} s" for rs in self.rulesets.values() for r in rs]

    def _matches(self, r: Rule) -> DataFrame | None:
        """Matches with at least one atom changed since the rule last ran; None if surely none."""
        q = r.query
        if not q.atoms:
            if r.fired:
                return None
            r.fired = True
            return evaluate(q, [], one_row=self.spark.range(1).select())
        tables = [self.tables[a.table] for a in q.atoms]
        if any(not t.rows for t in tables):
            return None
        names = self._needed(r)
        needed = [F.col(f"`{v}`") for v in q.sorts if v in names]
        visible = lambda df: df.where(~F.col("sub"))
        frame = lambda i, **range_: atom_frame(q.atoms[i], visible(self.store.read(tables[i], **range_)), tables[i].columns)
        how = {"needed": names, "sizes": [t.rows for t in tables], "strategy": self.strategy}
        if r.naive or self.naive or r.last == 0:
            variants = [evaluate(q, [frame(i) for i in range(len(tables))], **how)]
        else:
            variants = [
                evaluate(q, [frame(j, since=r.last) if j == i else frame(j, before=r.last) if j < i else frame(j) for j in range(len(tables))], first=i, **how)
                for i, t in enumerate(tables)
                if t.last >= r.last
            ]
        variants = [v.select(*needed) for v in variants]
        return reduce(DataFrame.unionByName, variants) if variants else None

    def _needed(self, r: Rule) -> set[str]:
        """Variables that a rule's head uses; all named ones where the head is a function, or matches are kept."""
        named = {v for v in r.query.sorts if v[0] != "_" or not v[1:].isdigit()}
        if self.tracing:
            return set(r.query.sorts)
        return named if r.host else named & (set().union(*map(symbols, r.actions)) | {v for v in named if v.endswith("!")})

    # -- actions ------------------------------------------------------------------------------

    def act(self, actions: list) -> None:
        """Top-level actions."""
        effects = Effects()
        self._act(actions, self.spark.range(1).select(), effects, {}, rule=False)
        if self.tracing and effects.edges:
            self.events.append(Event(self.step, None, self.spark.range(1).select(), {}, self.store.keep(reduce(DataFrame.unionByName, effects.edges))))
        self._apply(effects)

    def let(self, name: str, x) -> None:
        effects = Effects()
        df, value, sort = self._value(self.spark.range(1).select(), x, effects, {}, False)
        row = self.store.keep(df.select(value.alias("ret")))
        self._apply(effects)
        t = self.declare(name, "function", [], sort, "no-merge", extractable=False)
        self.globals[name] = sort
        self._find_ids(t)
        self.store.put(t, row.withColumn("ts", F.lit(self.step - 1).cast("long")).withColumn("sub", F.lit(False)))

    def _value(self, df: DataFrame, x, effects: Effects, sorts: dict[str, str], rule: bool, want: str | None = None) -> tuple[DataFrame, Column, str]:
        """Evaluates an expression for every match; constructors get or make their rows. ``want`` is the sort needed, if known."""
        if isinstance(x, Lit):
            return df, literal(x), x.sort
        if isinstance(x, Sym):
            if x.name in sorts:
                return df, F.col(f"`{x.name}`"), sorts[x.name]
            if x.name in self.globals:
                c = f"{x.name}!"
                if c not in df.columns:
                    df = df.join(F.broadcast(self.store.read(self.tables[x.name]).select(F.col("ret").alias(c))))
                return df, F.col(f"`{c}`"), self.globals[x.name]
            raise ProgramError(f"unbound variable {x.name}")
        name, cols, kinds = x[0].name, [], []
        t = self.tables.get(name)
        if t is None and name in containers.EMPTY and len(x) == 1:
            sort = scalar.unified(want or "?", containers.EMPTY[name])
            if sort is None:
                raise ProgramError(f"{name} is no {want}")
            return df, empty(sort), sort
        if t is None and name in self.SPECIAL:
            df, value, sort = self.special(name, df, x, effects, sorts, rule, want)
            return df, F.coalesce(value, F.raise_error(F.lit(f"{name} has no result"))), sort
        for k, a in enumerate(x[1:]):
            df, c, s = self._value(df, a, effects, sorts, rule, t.args[k] if t and k < len(t.args) else None)
            cols.append(c)
            kinds.append(s)
        if t is None and name in self.host_prims:
            for takes, gives, f, _ in self.host_prims[name]:
                if takes == kinds:
                    df, value = f(self, df, cols, effects)
                    return df, F.coalesce(value, F.raise_error(F.lit(f"{name} has no result"))), gives
        if t is None:
            found = applied(name, cols, kinds)
            if not found:
                raise ProgramError(f"{name}: no definition for {' '.join(kinds)}")
            return df, F.coalesce(found[0], F.raise_error(F.lit(f"{name} has no result"))), found[1]
        if kinds != t.args:
            raise ProgramError(f"{name} takes {' '.join(t.args)}, not {' '.join(kinds)}")
        df, value = self._call(df, t, cols, effects)
        if t.kind == "function":
            value = F.coalesce(value, F.raise_error(F.lit(f"{name} has no value")))
        return df, value, t.out or "Unit"

    def _call(self, df: DataFrame, t: Table, cols: list[Column], effects: Effects, here: Column | None = None) -> tuple[DataFrame, Column]:
        """A table's value for each row: a constructor's is made where there is none, a relation's row is added. Null where ``here`` is false."""
        name = t.name
        at = f"_c{len(df.columns)}_{len(effects.staged.get(name, []))}"
        keys = [f"{at}_k{i}" for i in range(len(cols))]
        df = df.select("*", *[c.alias(k) for c, k in zip(cols, keys, strict=True)], (F.lit(True) if here is None else here).alias(f"{at}_here"))
        wanted = df.where(f"{at}_here")
        own = [F.col(k).alias(n) for k, n in zip(keys, t.keys, strict=True)]
        if t.kind == "relation":
            effects.staged.setdefault(name, []).append(wanted.select(*own, F.lit(False).alias("sub")).distinct())
            return df, F.when(F.col(f"{at}_here"), F.lit(True))
        old = self.store.read(t).select(*[F.col(k).alias(n) for k, n in zip(t.keys, keys, strict=True)], F.col("ret").alias(f"{at}_ret"))
        df = df.join(old, keys, "left") if keys else df.join(old, F.lit(True), "left")
        if t.kind == "function":
            return df, F.when(F.col(f"{at}_here"), F.col(f"{at}_ret"))
        minted = self._mint(t, [F.col(k) for k in keys])
        fresh = df.where(F.col(f"{at}_here") & F.col(f"{at}_ret").isNull()).select(*own, minted.alias("ret"), F.lit(False).alias("sub"))
        effects.staged.setdefault(name, []).append(fresh.distinct())
        df = df.withColumn(f"{at}_id", F.when(F.col(f"{at}_here"), F.coalesce(F.col(f"{at}_ret"), minted)))
        return df, F.col(f"{at}_id")

    def _act(self, actions: list, df: DataFrame, effects: Effects, sorts: dict[str, str], rule: bool, keep: list[str] | None = None) -> None:
        for a in actions:
            head = a[0].name if isinstance(a, list) and a else None
            if head == "let":
                df, c, s = self._value(df, a[2], effects, sorts, rule)
                df = df.withColumn(a[1].name, c)
                sorts[a[1].name] = s
            elif head == "set":
                t = self.tables.get(a[1][0].name)
                if t is None or t.kind == "constructor":
                    raise ProgramError(f"can't set {a[1][0].name}")
                cols = []
                for x, want in zip([*a[1][1:], a[2]], [*t.args, t.out or "Unit"], strict=True):
                    df, c, s = self._value(df, x, effects, sorts, rule, want)
                    if s != want:
                        raise ProgramError(f"{t.name}: {s} is no {want}")
                    cols.append(c)
                effects.staged.setdefault(t.name, []).append(df.select(*[c.alias(k) for c, k in zip(cols, t.columns, strict=False)], F.lit(False).alias("sub"), *(keep or [])))
            elif head == "union":
                df, x, s = self._value(df, a[1], effects, sorts, rule)
                df, y, s2 = self._value(df, a[2], effects, sorts, rule)
                if s != s2 or not self.is_id(s):
                    raise ProgramError(f"can't union {s} and {s2}")
                effects.edges.append(df.select(x.alias("a"), y.alias("b")).where("a <> b"))
            elif head in ("delete", "subsume"):
                t = self.tables.get(a[1][0].name)
                if t is None or head == "subsume" and t.kind == "function":
                    raise ProgramError(f"can't {head} {a[1][0].name}")
                cols = []
                for x, want in zip(a[1][1:], t.args, strict=True):
                    df, c, _ = self._value(df, x, effects, sorts, rule, want)
                    cols.append(c)
                part = effects.removed if head == "delete" else effects.hidden
                part.setdefault(t.name, []).append(df.select(*[c.alias(k) for c, k in zip(cols, t.keys, strict=True)]).distinct())
            elif head == "panic":
                if df.limit(1).count():
                    raise ProgramError(f"panic: {a[1].value}")
            elif keep and isinstance(a, list) and (t := self.tables.get(a[0].name)) and t.kind == "relation":
                # As above, with the columns that tell the match.
                cols = []
                for x, want in zip(a[1:], t.args, strict=True):
                    df, c, _ = self._value(df, x, effects, sorts, rule, want)
                    cols.append(c)
                effects.staged.setdefault(t.name, []).append(df.select(*[c.alias(k) for c, k in zip(cols, t.columns, strict=True)], F.lit(False).alias("sub"), *keep))
            else:
                df, c, s = self._value(df, a, effects, sorts, rule)

    # -- merging ------------------------------------------------------------------------------

    def _apply(self, effects: Effects) -> bool:
        """Applies staged effects; True if any row is new, changed, hidden or gone."""
        now, changed = self.step, False
        made = Effects(edges=[self.store.keep(reduce(DataFrame.unionByName, effects.edges).distinct())] if effects.edges else [])
        # All reads what was there before: segments are never overwritten. What is used once isn't written first.
        once = lambda n: self.tables[n].kind != "function"
        staged = {n: (lambda df, n=n: df if once(n) else self.store.keep(df))(reduce(DataFrame.unionByName, dfs)) for n, dfs in effects.staged.items()}
        removed = {n: self.store.keep(reduce(DataFrame.unionByName, dfs).distinct()) for n, dfs in effects.removed.items()}
        hidden = {n: self.store.keep(reduce(DataFrame.unionByName, dfs).distinct()) for n, dfs in effects.hidden.items()}
        for name in {**staged, **removed, **hidden}:
            t = self.tables[name]
            before = t.rows
            if name in removed and before:
                if self._large(t) and self.store.few(removed[name]):
                    self.store.replace(t, None, removed[name])
                else:
                    self.store.put(t, self.store.read(t).join(removed[name], t.keys, "left_anti"))
                changed |= t.rows < before
            if name in staged:
                changed |= self._insert(t, staged[name], now, made)
            if name in hidden and t.rows:
                changed |= self._hide(t, hidden[name], now)
        edges, made.edges = made.edges, []
        if made.staged:
            # Rows that merges made; their own merges can make more.
            changed |= self._apply(made)
        else:
            self.step += 1
        if edges and self._rebuild(edges):
            changed = True
        return changed

    def _insert(self, t: Table, new: DataFrame, now: int, effects: Effects) -> bool:
        new = new.withColumn("ts", F.lit(now).cast("long"))
        if t.kind == "relation" or t.kind == "constructor":
            unique = new.groupBy(*t.keys).agg(*([F.min("ret").alias("ret")] if t.out else []), F.min("ts").alias("ts"), F.bool_or("sub").alias("sub")) if t.keys else new.limit(1)
            if not t.rows:
                return self.store.append(t, unique) > 0
            old = self.store.read(t).select(*t.keys)
            if self._large(t):
                unique = self.store.keep(unique)
                if self.store.few(unique):
                    # The table is only read along: what it has of the few new keys is found, and left out.
                    known = self.store.keep(old.join(F.broadcast(unique.select(*t.keys)), t.keys, "left_semi"))
                    return self.store.append(t, unique.join(F.broadcast(known), t.keys, "left_anti")) > 0
            unique = unique.join(old, t.keys, "left_anti") if t.keys else unique.limit(0)
            return self.store.append(t, unique) > 0
        if not t.rows:
            merged = self._merged(t, new.withColumn("old", F.lit(False)), now, effects)
            return self.store.append(t, merged) > 0
        # Only keys that the step touched are merged; the rest is carried over.
        old = self.store.read(t)
        if not t.keys:
            held = old.withColumn("old", F.lit(True))
        else:
            touched = new.select(*t.keys).distinct()
            few = self._large(t) and self.store.few(new)
            held = old.join(F.broadcast(touched) if few else touched, t.keys, "left_semi").withColumn("old", F.lit(True))
        merged = self.store.keep(self._merged(t, new.withColumn("old", F.lit(False)).unionByName(held), now, effects))
        fresh = merged.where(F.col("ts") == now)
        if not fresh.take(1):
            return False
        if self._large(t) and self.store.few(fresh):
            self.store.replace(t, fresh, fresh.select(*t.keys))
            return True
        rest = old.join(fresh.select(*t.keys), t.keys, "left_anti") if t.keys else old.limit(0)
        self.store.put(t, rest.unionByName(fresh))
        return True

    def _large(self, t: Table) -> bool:
        """Whether it pays to leave a table's older segments as they are."""
        return bool(t.keys) and t.rows > store.SMALL

    def _merged(self, t: Table, rows: DataFrame, now: int, effects: Effects) -> DataFrame:
        """One row a key. Values merge in ascending order, the held one first."""
        grouped = rows.groupBy(*t.keys)
        held = [F.max(F.when(F.col("old"), F.col("ret"))).alias("was"), F.max(F.when(F.col("old"), F.col("ts"))).alias("was_ts"), F.bool_or("sub").alias("sub")]
        m = t.merge
        name = m[0].name if isinstance(m, list) and m[1:] in ([Sym("old"), Sym("new")], [Sym("new"), Sym("old")]) else None
        if m == "no-merge":
            out = grouped.agg(*held, F.min("ret").alias("ret"), F.max("ret").alias("other"))
            bad = out.where(~F.col("ret").eqNullSafe(F.col("other"))).limit(1)
            if bad.count():
                raise ProgramError(f"{t.name}: two values for one key, and no merge")
            out = out.drop("other")
        elif m == "union":
            # Each value is joined with the key's least one: no list of values, and a hot key can be split.
            out = self.store.keep(grouped.agg(*held, F.min("ret").alias("ret"), F.max("ret").alias("other")))
            unequal = out.where("ret <> other").select(*t.keys, F.col("ret").alias("a"))
            both = rows.select(*t.keys, F.col("ret").alias("b"))
            pairs = both.join(unequal, t.keys) if t.keys else both.crossJoin(unequal)
            effects.edges.append(self.store.keep(pairs.select("a", "b").where("a <> b").distinct()))
            out = out.drop("other")
        elif name in LATTICE:
            out = grouped.agg(*held, LATTICE[name]("ret").alias("ret"))
        elif name == "set-union":
            # Elements are made distinct before they are gathered.
            some = rows.select(*t.keys, F.explode("ret").alias("e")).distinct().groupBy(*t.keys).agg(F.array_sort(F.collect_list("e")).alias("ret"))
            out = grouped.agg(*held)
            out = (out.join(some, t.keys, "left") if t.keys else out.join(some, F.lit(True), "left")).withColumn("ret", F.coalesce("ret", F.array().cast(rows.schema["ret"].dataType)))
        elif self._calls_tables(m):
            return self._merged_by_tables(t, rows, now, effects).select(*t.columns, "ts", "sub")
        elif name == "+" and t.out in ("i64", "f64"):
            # Sums need no list of values; whole numbers are summed wide, and a sum out of range is none.
            total = F.sum(F.col("ret").cast("decimal(38,0)")).try_cast("long") if t.out == "i64" else F.sum("ret")
            out = grouped.agg(*held, total.alias("ret"))
        elif m == Sym("old"):
            out = grouped.agg(*held, F.min(F.when(~F.col("old"), F.col("ret"))).alias("first")).withColumn("ret", F.coalesce("was", "first")).drop("first")
        elif m == Sym("new"):
            out = grouped.agg(*held, F.max(F.when(~F.col("old"), F.col("ret"))).alias("last")).withColumn("ret", F.coalesce("last", "was")).drop("last")
        else:
            values = F.array_sort(F.collect_list(F.struct((~F.col("old")).alias("o"), "ret")))
            out = grouped.agg(*held, F.transform(values, lambda s: s["ret"]).alias("values"))
            fold = lambda a, b: self._merge_value(t, m, a, b)
            out = out.withColumn("ret", F.aggregate(F.expr("slice(values, 2, greatest(size(values) - 1, 0))"), F.get("values", F.lit(0)), fold)).drop("values")
        same = F.col("was").isNotNull() & F.col("ret").eqNullSafe(F.col("was"))
        return out.withColumn("ts", F.when(same, F.col("was_ts")).otherwise(F.lit(now).cast("long"))).select(*t.columns, "ts", "sub")

    def _calls_tables(self, m) -> bool:
        return isinstance(m, list) and (m[0].name in self.tables or m[0].name in self.SPECIAL or any(self._calls_tables(a) for a in m[1:]))

    def _merged_by_tables(self, t: Table, rows: DataFrame, now: int, effects: Effects) -> DataFrame:
        """Values of a key merge one after another, the held one first, by an expression that makes rows of its own.

        Each round merges the next value of every key, so there are as many rounds as the key with most values has.
        A value equal to the one so far changes nothing.
        """
        held = [F.max(F.when(F.col("old"), F.col("ts"))).alias("was_ts"), F.bool_or("sub").alias("sub")]
        values = F.array_sort(F.collect_set(F.struct((~F.col("old")).alias("late"), "ret")))
        left = self.store.keep(rows.groupBy(*t.keys).agg(*held, F.transform(values, lambda s: s["ret"]).alias("values")))
        left = left.withColumn("old", F.get("values", F.lit(0))).withColumn("was", F.when(F.col("was_ts").isNotNull(), F.col("old")))
        most, done = left.agg(F.max(F.size("values"))).first()[0] or 0, []
        names = [*t.keys, "was_ts", "was", "sub", "values", "old"]
        for k in range(1, most):
            done.append(left.where(F.size("values") <= k).select(*names))
            df = left.where(F.size("values") > k).withColumn("new", F.get("values", F.lit(k)))
            same = df.where(F.col("old").eqNullSafe(F.col("new"))).select(*names)
            df = df.where(~F.col("old").eqNullSafe(F.col("new")))
            df, value, sort = self._value(df, t.merge, effects, {"old": t.out, "new": t.out}, True, t.out)
            if sort != t.out:
                raise ProgramError(f"{t.name}: the merge gives {sort}, not {t.out}")
            merged = df.withColumn("merged!", value).select(*[F.col("merged!").alias("old") if n == "old" else F.col(n) for n in names])
            left = self.store.keep(merged.unionByName(same))
        out = reduce(DataFrame.unionByName, done, left.select(*names)).withColumnRenamed("old", "ret")
        unchanged = F.col("was").isNotNull() & F.col("ret").eqNullSafe(F.col("was"))
        return out.withColumn("ts", F.when(unchanged, F.col("was_ts")).otherwise(F.lit(now).cast("long")))

    def _merge_value(self, t: Table, x, old: Column, new: Column) -> Column:
        def value(x) -> tuple[Column, str]:
            if x in (Sym("old"), Sym("new")):
                return (old if x.name == "old" else new), t.out
            if isinstance(x, Lit):
                return literal(x), x.sort
            if not isinstance(x, list):
                raise ProgramError(f"{t.name}: a merge knows old and new only")
            if x[0].name in containers.EMPTY and len(x) == 1:
                sort = scalar.unified(t.out, containers.EMPTY[x[0].name]) or containers.EMPTY[x[0].name]
                return empty(sort), sort
            parts = [value(a) for a in x[1:]]
            found = applied(x[0].name, [c for c, _ in parts], [s for _, s in parts])
            if not found:
                raise ProgramError(f"{t.name}: no definition of {x[0].name}")
            return found

        return value(x)[0]

    def _hide(self, t: Table, keys: DataFrame, now: int) -> bool:
        old = self.store.read(t)
        hit = self.store.keep(old.where(~F.col("sub")).join(keys, t.keys, "left_semi"))
        if not hit.take(1):
            return False
        hidden = hit.withColumn("sub", F.lit(True)).withColumn("ts", F.lit(now).cast("long"))
        if self._large(t) and self.store.few(hit):
            self.store.replace(t, hidden, hit.select(*t.keys))
        else:
            self.store.put(t, old.join(hit.select(*t.keys), t.keys, "left_anti").unionByName(hidden))
        return True

    # -- equality -----------------------------------------------------------------------------

    def _rebuild(self, edges: list[DataFrame]) -> bool:
        """Replaces ids by the least of their class, and merges rows that then collide, until none do."""
        any_change = False
        while True:
            pairs = reduce(DataFrame.unionByName, edges) if edges else None
            if pairs is None or not pairs.take(1):
                return any_change
            any_change = True
            moved = self.store.keep(connected_components(self.spark, pairs).where("node <> root").distinct())
            now = self.step
            if self.store.few(moved):
                moved = F.broadcast(moved)  # two numbers a row, so at most some megabytes
            made = Effects()
            for t in list(self.tables.values()):
                if not (t.ids or t.boxed) or not t.rows:
                    continue
                rows, names = self.store.read(t), t.columns
                maps = {i: moved.select(F.col("node").alias(names[i]), F.col("root").alias(f"{names[i]}_root")) for i in t.ids}
                for i, sort in t.boxed.items():
                    values = rows.select(F.col(names[i]).alias("old")).distinct()
                    found = moved_functions(values, self.fn_uses, self.is_id, moved) if sort.startswith("UnstableFn<") else moved_values(values, sort, self.is_id, moved)
                    if found is not None:
                        maps[i] = found.select(F.col("old").alias(names[i]), F.col("new").alias(f"{names[i]}_root"))
                if not maps:
                    continue
                touched = F.lit(False)
                for i, m in maps.items():
                    rows = rows.join(m, names[i], "left")
                    touched = touched | F.col(f"{names[i]}_root").isNotNull()
                rows = rows.withColumn("hit", touched)
                if self._large(t) and t.name not in self.globals:
                    hits = self.store.keep(rows.where("hit"))
                    if not hits.take(1):
                        continue
                    if self.store.few(hits):
                        self._rename_few(t, hits, maps, now, made)
                        continue
                for i in maps:
                    rows = rows.withColumn(names[i], F.coalesce(F.col(f"{names[i]}_root"), F.col(names[i])))
                rows = self.store.keep(rows.withColumn("ts", F.when(F.col("hit"), F.lit(now).cast("long")).otherwise(F.col("ts"))).select(*names, "ts", "sub", "hit"))
                if not rows.where("hit").take(1):
                    continue
                if t.kind == "relation" or not t.keys and t.name in self.globals:
                    rows = rows.groupBy(*names).agg(F.min("ts").alias("ts"), F.bool_or("sub").alias("sub"))
                else:
                    # Rows of one key: the one that stayed is the held one.
                    rows = self._merged(t, rows.withColumn("old", ~F.col("hit")).drop("hit"), now, made)
                self.store.put(t, rows)
            edges = made.edges
            if self.tracing:
                self.rebuilt += [(now, self.store.keep(e)) for e in edges]
            self.step += 1
            if made.staged:
                made.edges = []
                self._apply(made)

    def _rename_few(self, t: Table, hits: DataFrame, maps: dict, now: int, made: Effects) -> None:
        """Takes the rows that hold moved ids out and puts them in again, merged with those whose keys they now have."""
        names = t.columns
        before = hits.select(*t.keys)
        renamed = hits.select(*[F.coalesce(F.col(f"{n}_root"), F.col(n)).alias(n) if i in maps else F.col(n) for i, n in enumerate(names)], F.lit(now).cast("long").alias("ts"), "sub")
        renamed = self.store.keep(renamed)
        keys = renamed.select(*t.keys).distinct()
        met = self.store.read(t).join(F.broadcast(keys), t.keys, "left_semi").join(F.broadcast(before), t.keys, "left_anti").select(*names, "ts", "sub")
        if t.kind == "relation":
            fresh = renamed.unionByName(met).groupBy(*names).agg(F.min("ts").alias("ts"), F.bool_or("sub").alias("sub"))
        else:
            fresh = self._merged(t, renamed.withColumn("old", F.lit(False)).unionByName(met.withColumn("old", F.lit(True))), now, made)
        self.store.replace(t, self.store.keep(fresh), before.unionByName(keys))

    # -- queries ------------------------------------------------------------------------------

    def query(self, variables: list[str], facts: str) -> DataFrame:
        """Distinct bindings of variables; hidden rows take no part."""
        return self._solve(read(facts), hidden=False, needed=set(variables)).select(*[F.col(f"`{v}`") for v in variables]).distinct()

    def _solve(self, facts: list, hidden: bool, needed: set[str] | None = None) -> DataFrame:
        q = self.compiler().query(facts)
        frames = []
        for a in q.atoms:
            t = self.tables[a.table]
            df = self.store.read(t)
            frames.append(atom_frame(a, df if hidden else df.where(~F.col("sub")), t.columns))
        return evaluate(q, frames, one_row=self.spark.range(1).select(), needed=needed, sizes=[self.tables[a.table].rows for a in q.atoms], strategy=self.strategy)

    def check(self, facts: list) -> bool:
        """Whether all facts hold at once; hidden rows count."""
        return bool(self._solve(facts, hidden=True, needed=set()).limit(1).count())

    def difference(self, facts: str, excluded: str, variables: list[str]) -> DataFrame:
        """Bindings of facts that no binding of ``excluded`` shares."""
        return self.query(variables, facts).join(self.query(variables, excluded), variables, "left_anti")

    def rows(self, name: str) -> DataFrame:
        """A table's rows, hidden ones included."""
        t = self.tables[name]
        return self.store.read(t).select(*t.columns)

    def size(self, name: str) -> int:
        if name not in self.tables:
            raise ProgramError(f"unbound function {name}")
        return self.tables[name].rows
