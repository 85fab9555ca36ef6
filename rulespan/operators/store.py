"""Tables as lists of immutable written segments, each with the range of steps that its rows came in."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sorts import spark_type
from ..session import Scratch

#: Segments beyond which a table is written as one.
COMPACT = 24
#: Tables of up to so many rows are written anew when rows in them change.
SMALL = 200_000
#: Rows (of keys, or changed ones) up to which they are broadcast, always after counting them.
FEW = 500_000


@dataclass(frozen=True)
class Segment:
    path: str
    first: int
    last: int
    rows: int


@dataclass
class Table:
    """``k0.. [ret] ts sub``: keys, value, the step that last changed the row, and whether it is hidden."""

    name: str
    kind: str  # relation, constructor or function
    args: list[str]
    out: str | None
    merge: object = None
    cost: int = 1
    extractable: bool = True
    segments: tuple[Segment, ...] = ()
    ids: list[int] = field(default_factory=list)
    over: Segment | None = None  # rows in place of those of the same keys in the segments
    dead: Segment | None = None  # keys of rows in the segments that don't count any more; each is in a segment once
    boxed: dict[int, str] = field(default_factory=dict)  # columns of containers and functions that can hold ids, with their sorts

    @property
    def keys(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.args))]

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *(["ret"] if self.out else [])]

    @property
    def schema(self) -> T.StructType:
        s = T.StructType()
        for k, sort in zip(self.columns, [*self.args, *([self.out] if self.out else [])], strict=True):
            s = s.add(k, spark_type(sort))
        return s.add("ts", T.LongType()).add("sub", T.BooleanType())

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.parts) - (self.dead.rows if self.dead else 0)

    @property
    def parts(self) -> tuple[Segment, ...]:
        return self.segments + ((self.over,) if self.over else ())

    @property
    def last(self) -> int:
        return max((s.last for s in self.parts), default=-1)

    def clear(self) -> None:
        self.segments, self.over, self.dead = (), None, None

    def copy(self) -> Table:
        return replace(self)


class Store:
    """Reads and writes segments.

    Rows that change in a large table go to its ``over`` segment, and their keys to ``dead``, which hides them in the
    older segments: both are small, so reading broadcasts the keys, and the older segments are neither shuffled nor
    written again. When they grow, the table is written as one segment.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.scratch = Scratch(spark, "program")
        self.made = 0

    def read(self, table: Table, since: int = -1, before: int | None = None) -> DataFrame:
        """Rows whose step is in the range; segments outside it aren't opened."""
        wanted = lambda s: s.last >= since and (before is None or s.first < before)
        paths = [s.path for s in table.segments if wanted(s)]
        frames = []
        if paths:
            df = self.spark.read.schema(table.schema).parquet(*paths)
            if table.dead:
                df = df.join(F.broadcast(self._keys(table.dead, table)), table.keys, "left_anti").select(*df.columns)
            frames.append(df)
        if table.over and wanted(table.over):
            frames.append(self.spark.read.schema(table.schema).parquet(table.over.path))
        if not frames:
            return self.spark.createDataFrame([], table.schema)
        df = reduce(DataFrame.unionByName, frames)
        if since > 0:
            df = df.where(F.col("ts") >= since)
        return df if before is None else df.where(F.col("ts") < before)

    def _keys(self, segment: Segment, table: Table) -> DataFrame:
        return self.spark.read.schema(T.StructType([table.schema[k] for k in table.keys])).parquet(segment.path)

    def _path(self, table: Table) -> str:
        self.made += 1
        return f"{self.scratch.path}/{self.made}-{abs(hash(table.name)) % 10**8}"

    def write(self, table: Table, df: DataFrame) -> Segment | None:
        """A new segment, or None if ``df`` is empty."""
        df.select(*table.columns, "ts", "sub").write.parquet(path := self._path(table))
        n, first, last = self.spark.read.schema(table.schema).parquet(path).agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
        return Segment(path, first, last, n) if n else None

    def append(self, table: Table, df: DataFrame) -> int:
        s = self.write(table, df)
        if s:
            table.segments += (s,)
            if len(table.segments) > COMPACT:
                self.put(table, self.read(table))
        return s.rows if s else 0

    def put(self, table: Table, df: DataFrame) -> None:
        s = self.write(table, df)
        table.clear()
        table.segments = (s,) if s else ()

    def replace(self, table: Table, fresh: DataFrame | None, gone: DataFrame) -> None:
        """Takes rows of the keys in ``gone`` out, and puts ``fresh`` in, whose keys are either new or in ``gone``.

        Both are few; ``gone`` may name keys that the table doesn't have.
        """
        gone = F.broadcast(gone.select(*table.keys).distinct())
        if not table.segments or table.rows <= SMALL or not table.keys:
            rest = self.read(table).join(gone, table.keys, "left_anti")
            self.put(table, rest.unionByName(fresh) if fresh is not None else rest)
            return
        base = self.spark.read.schema(table.schema).parquet(*[s.path for s in table.segments]).select(*table.keys)
        hidden = base.join(gone, table.keys, "left_semi")
        if table.dead:
            hidden = hidden.unionByName(self._keys(table.dead, table)).distinct()
        hidden.write.parquet(path := self._path(table))
        n = self.spark.read.parquet(path).count()
        parts = [self.spark.read.schema(table.schema).parquet(table.over.path).join(gone, table.keys, "left_anti")] if table.over else []
        parts += [fresh.select(*table.columns, "ts", "sub")] if fresh is not None else []
        over = self.write(table, reduce(DataFrame.unionByName, parts)) if parts else None
        table.over, table.dead = over, Segment(path, -1, -1, n) if n else None
        if n + (over.rows if over else 0) > FEW:
            self.put(table, self.read(table))

    def few(self, df: DataFrame) -> bool:
        """Whether a written table has few enough rows to be broadcast."""
        return df.limit(FEW + 1).count() <= FEW

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        return self.scratch.put(df, str(self.made))

    def close(self) -> None:
        """Deletes all that was written; DataFrames over it can't be read any more."""
        self.scratch.drop()
