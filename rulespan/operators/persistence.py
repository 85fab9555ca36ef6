"""Saving a program at a step, and going on from there in another session."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..plans.parser import Lit, Sym, read

#: Commands that declare something; what they declared is declared again on resuming.
DECLARE = {"sort", "datatype", "datatype*", "constructor", "function", "relation", "ruleset", "unstable-combined-ruleset", "rule", "rewrite", "birewrite"}


def unread(x) -> str:
    """Text that reads back as the same expression."""
    if isinstance(x, list):
        return f"({' '.join(map(unread, x))})"
    if isinstance(x, Sym):
        return x.name
    if isinstance(x, Lit) and isinstance(x.value, str):
        return '"' + x.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    v = x.value
    return str(v).lower() if isinstance(v, bool) else repr(v)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


class Persistence:
    """Saving and resuming. Only between steps, as all commands are."""

    def save(self, path: str, **more) -> None:
        """Writes all tables as Parquet under ``path``, and last of all the control record, without which nothing is resumed."""
        tables = {}
        version = f"step-{self.step}"
        for k, (name, t) in enumerate(self.tables.items()):
            where = f"{version}/{k}"
            if t.rows:
                self.store.read(t).write.mode("overwrite").parquet(f"{path}/{where}")
            tables[name] = {"path": where if t.rows else None, "first": min((s.first for s in t.parts), default=0), "last": t.last, "rows": t.rows, "kind": t.kind, "out": t.out}
        marks = [[r.last, r.fired, r.matches] for rs in self.rulesets.values() for r in rs]
        control = {"declared": [unread(c) for c in self.declared], "globals": self.globals, "step": self.step, "tables": tables, "marks": marks, "uses": [[n, list(g)] for n, g in sorted(self.fn_uses)], "more": more}
        _write_text(self.spark, f"{path}/control", json.dumps(control))

    @classmethod
    def resume(cls, spark: SparkSession, path: str, **options):
        """The program that was saved under ``path``; its rules go on with what changed since they last ran."""
        from .store import Segment

        control = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/control").collect()))
        p = cls(spark, **options)
        for c in control["declared"]:
            p.command(read(c)[0])
        for name, sort in control["globals"].items():
            t = p.declare(name, "function", [], sort, "no-merge", extractable=False)
            p.globals[name] = sort
            p._find_ids(t)
        p.fn_uses = {(n, tuple(g)) for n, g in control["uses"]}
        for name, s in control["tables"].items():
            if s["path"]:
                p.tables[name].segments = (Segment(f"{path}/{s['path']}", s["first"], s["last"], s["rows"]),)
        p.step = control["step"]
        for r, (last, fired, matches) in zip((r for rs in p.rulesets.values() for r in rs), control["marks"], strict=True):
            r.last, r.fired, r.matches = last, fired, matches
        p.resumed = control["more"]
        return p


def saved(spark: SparkSession, path: str) -> bool:
    """Whether a control record is there."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/control/_SUCCESS")
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def export_rows(program, name: str) -> DataFrame:
    """A table's rows with their steps, as they would be saved."""
    return program.store.read(program.tables[name])
