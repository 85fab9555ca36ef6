"""Files: tab-separated facts, Parquet facts, appended terms, exported tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parser import ProgramError


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def read_facts(spark: SparkSession, path: str, types: list) -> DataFrame:
    """Tab-separated fields without header or quotes; trimmed; blank lines skipped; other arity fails."""
    fields = F.split(F.col("value"), "\t", -1)
    lines = spark.read.text(path).where(F.trim("value") != "")
    n = len(types)
    checked = F.when(F.size(fields) == n, fields).otherwise(F.raise_error(F.concat(F.lit(f"{path}: {n} fields are needed: "), F.col("value"))))
    return lines.select(checked.alias("f")).select(*[F.trim(F.get("f", F.lit(i))).cast(t).alias(f"c{i}") for i, t in enumerate(types)])


def input_file(program, name: str, path: str) -> None:
    """Loads a file into a table."""
    t = program.tables.get(name)
    if t is None:
        raise ProgramError(f"unbound function {name}")
    types = [t.schema[k].dataType for k in (t.keys if t.kind != "function" else t.columns)]
    df = program.spark.read.parquet(path) if path.endswith(".parquet") else read_facts(program.spark, path, types)
    program.load(name, df)


def output_terms(program, path: str, exprs: list) -> None:
    """Appends the cheapest term of each expression, one a line."""
    terms = [program.extract(x)[0][1] for x in exprs]
    program.spark.createDataFrame([(t,) for t in terms], "value string").coalesce(1).write.mode("append").text(path)


def export_tables(program, path: str) -> None:
    """Every table as Parquet under its name."""
    for name in program.tables:
        program.rows(name).write.mode("overwrite").parquet(f"{path}/{name}")


def export_graph(program, path: str) -> None:
    """Nodes as JSON lines: table, arguments, class."""
    for t in program.tables.values():
        if t.kind == "constructor" and t.rows:
            args = F.to_json(F.struct(*[F.col(k) for k in t.keys])) if t.keys else F.lit("{}")
            program.store.read(t).select(F.lit(t.name).alias("op"), args.alias("children"), F.col("ret").cast("string").alias("eclass"), F.lit(t.cost).alias("cost"), F.col("sub").alias("subsumed")).write.mode("append").json(path)


def export_dot(program, path: str) -> None:
    """The terms as a graph in the DOT language: a box for each class, a node for each row, an edge to each argument's class."""
    parts = [program.spark.createDataFrame([("0", "digraph terms { compound=true; node [shape=record];")], "at string, line string")]
    for t in program.tables.values():
        if t.kind != "constructor" or not t.rows:
            continue
        rows = program.store.read(t)
        node = F.concat(F.lit('"n'), F.abs(F.xxhash64(F.lit(t.name), *t.keys)).cast("string"), F.lit('"'))
        box = lambda c: F.concat(F.lit('"c'), F.col(c).cast("string"), F.lit('"'))
        values = [F.col(k).cast("string") for i, k in enumerate(t.keys) if i not in t.ids and i not in t.boxed]
        label = F.replace(F.concat_ws(" ", F.lit(t.name), *values), F.lit('"'), F.lit("'"))
        lines = [F.concat(F.lit("subgraph cluster_"), F.replace(F.col("ret").cast("string"), F.lit("-"), F.lit("m")), F.lit(" { "), node, F.lit(' [label="'), label, F.lit('"]; '), box("ret"), F.lit(" [shape=point]; }"))]
        lines += [F.concat(node, F.lit(" -> "), box(f"k{i}"), F.lit(";")) for i in t.ids if i < len(t.args)]
        parts.append(rows.select(F.lit("1").alias("at"), F.explode(F.array(*lines)).alias("line")))
    parts.append(program.spark.createDataFrame([("2", "}")], "at string, line string"))
    reduce(DataFrame.unionByName, parts).orderBy("at", "line").coalesce(1).select("line").write.mode("overwrite").text(path)
