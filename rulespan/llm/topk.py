"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are cut into blocks of a fixed number of rows. In a block's index, the postings of a dimension are
quantised into a few levels of magnitude; a segment is the postings of one dimension and level, and its impact
for a query is its largest magnitude times the query's component. A query takes the segments in descending
order of impact, in rounds, adding to one accumulator of score and two of energy for each row. By
Cauchy-Schwarz, what is left of a row's score lies within the root of the product of what is left of both
energies. A query's walk stops only when this bound proves that few rows can still be among its k best; these
are scored again exactly. Where no proof comes, the walk ends with all postings added, and all rows that
rounding leaves in doubt are scored exactly.

All queries of a block take a round together, so that the sums of a round are three matrix products. A query's
k-th score so far is carried from block to block, and blocks whose longest vector can't reach it are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and queries of a block.
BLOCK, QUERIES = 4096, 512
#: Shares of a block's postings at or above each level of magnitude; the rest is the last level.
LEVELS = (0.12, 0.4)
#: Shares of a query's segments taken by the end of each round.
ROUNDS = (0.6, 0.8, 1.0)
#: Blocks of rows, and of queries, that one task takes at most, and tasks wanted for each block of queries.
TASK_ROWS, TASK_QUERIES, TASKS = 64, 32, 64
#: Rows scored exactly at once.
EXACT = 1 << 16
NONE = -(2**63)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """``id, v``: floor(scale * x) of each component; without vectors that are null or hold a null or non-finite one."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias(vector_col)).where(F.col(vector_col).isNotNull() & ~bad)
    return rows.select("id", F.transform(vector_col, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


_COLUMNS = "kind int, ids binary, size int, x binary"


def _packed(kind: int, ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
    """A block as one row: ids and components, in the fewest bytes that hold them."""
    x = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    least = max(np.min_scalar_type(int(x.min(initial=0))).itemsize, np.min_scalar_type(-1 - int(x.max(initial=0))).itemsize)
    values = [[kind], [np.array(ids, np.int64).tobytes()], [least], [x.astype(f"i{least}").tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["kind", "ids", "size", "x"])


def _blocks(rows: DataFrame, size: int, kind: int) -> DataFrame:
    """Rows packed into blocks of at most ``size``, one Arrow row each; ``number`` is their partition's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            v = batch.column(1)
            flat, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids.append(key)
                vectors.append(flat[at[i] : at[i + 1]])
                if len(ids) == size:
                    yield _packed(kind, ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield _packed(kind, ids, vectors)

    return rows.where("id is not null").mapInArrow(task, _COLUMNS).withColumn("number", F.spark_partition_id())


def _unpacked(ids: bytes, size: int, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, np.frombuffer(x, f"i{size}").reshape(len(keys), -1).astype(np.int64)


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """With zeros added, or what lies beyond the other side's length left out."""
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width]


class ImpactIndex:
    """The postings of one block of rows, by dimension and level of magnitude."""

    def __init__(self, x: np.ndarray, levels: tuple[float, ...] = LEVELS):
        self.x, (self.n, self.width) = x, x.shape
        self.parts = len(levels) + 1
        size = np.abs(x)
        level = np.full(x.shape, len(levels), np.int8)
        for k in reversed(range(len(levels))):
            if x.size:
                level[size >= max(1.0, np.quantile(size, 1 - levels[k]))] = k
        f = x.astype(np.float32)
        # Column k * width + d is the segment of dimension d and level k; rows it doesn't hold have zeros.
        held = np.concatenate([level == k for k in range(self.parts)], 1)
        self.present = held.astype(np.float32)
        self.values = np.where(held, np.tile(f, (1, self.parts)), np.float32(0))
        self.squares = self.values**2
        self.peaks = np.abs(self.values).max(0, initial=0)
        self.energy = self.squares.sum(1)
        self.longest = float(np.sqrt(self.energy.max(initial=0)))

    def search(self, q: np.ndarray, k: int, floor: np.ndarray, own: np.ndarray | None = None, rounds: tuple[float, ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and exact score of all rows that can be among the k best of a query.

        ``floor`` is a score of each query that its k best reach, or NONE; it is raised in place. Rows where
        ``own`` (queries by rows) is true are no candidates.
        """
        empty = np.empty(0, np.int64)
        if not self.n or not len(q):
            return empty, empty, empty
        weight = np.tile(q.astype(np.float32), (1, self.parts))
        total = (q.astype(np.float64) ** 2).sum(1).astype(np.float32)[:, None]
        doubt = np.float32(4e-7 * (self.width + 8))  # of rounding, as a share of both energies
        # What a block's longest vector can't reach is no candidate.
        live = np.flatnonzero(np.sqrt(total[:, 0]) * self.longest * 1.001 + 1 >= floor)
        walk = np.argsort(-self.peaks * np.abs(weight), axis=1, kind="stable")
        rank = np.empty_like(walk)
        np.put_along_axis(rank, walk, np.arange(walk.shape[1])[None, :], 1)
        score, got, left = (np.zeros((len(live), self.n), np.float32) for _ in range(3))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        few, begin = max(8 * k, self.n // 64), 0
        for share in rounds:
            if not len(live):
                break
            end = round(share * walk.shape[1])
            taken = (rank[live] >= begin) & (rank[live] < end)
            columns = np.flatnonzero(taken.any(0))
            taken = taken[:, columns]
            w = np.where(taken, weight[live][:, columns], np.float32(0))
            score += w @ self.values[:, columns].T
            got += taken.astype(np.float32) @ self.squares[:, columns].T
            left += w**2 @ self.present[:, columns].T
            if own is not None:
                score[own[live]] = -np.inf
            if not begin and self.n > k:
                best = np.argpartition(-score, k, axis=1)[:, :k]
                sure = np.einsum("ijk,ik->ij", self.x[best], q[live])
                real = np.isfinite(np.take_along_axis(score, best, 1)).all(1)
                floor[live] = np.where(real, np.maximum(floor[live], sure.min(1)), floor[live])
            begin = end
            rest, unused = (np.maximum(e - s, 0) + doubt * e for e, s in ((self.energy, got), (total[live], left)))
            may = score + np.sqrt(rest * unused) + 1 >= floor[live][:, None]
            if own is not None:
                may &= ~own[live]
            proved = (may.sum(1) <= few) | (share >= 1)
            a, rows = np.nonzero(may[proved])
            asked = live[proved][a]
            exact = [np.einsum("ij,ij->i", self.x[rows[i : i + EXACT]], q[asked[i : i + EXACT]]) for i in range(0, len(rows), EXACT)]
            out.append((asked, rows, np.concatenate(exact) if exact else empty))
            live, score, got, left = live[~proved], score[~proved], got[~proved], left[~proved]
        found = tuple(np.concatenate([o[i] for o in out]) if out else empty for i in range(3))
        reach = found[2] >= floor[found[0]]
        return found[0][reach], found[1][reach], found[2][reach]


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of highest score of each query, equal scores by key."""
    order = np.lexsort((key, -score, query))
    query, key, score = query[order], key[order], score[order]
    start = np.searchsorted(query, query)
    keep = np.arange(len(query)) - start < k
    return query[keep], key[keep], score[keep]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A cell's blocks of queries come first, then its blocks of rows, one after another."""
    cell, asked = None, []

    def found() -> Iterator[pa.RecordBatch]:
        for ids, _, _, best in asked:
            query, key, score = best
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(key), pa.array(score)], names=["query_id", "vec_id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            here, kind, ids, size, x = (batch.column(c)[i].as_py() for c in ("cell", "kind", "ids", "size", "x"))
            if here != cell:
                yield from found()
                cell, asked = here, []
            keys, x = _unpacked(ids, size, x)
            if kind == 0:
                asked.append([keys, x, np.full(len(keys), NONE), tuple(np.empty(0, np.int64) for _ in range(3))])
                continue
            index = ImpactIndex(x)
            for block in asked:
                wanted, q, floor, best = block
                own = wanted[:, None] == keys if np.isin(wanted, keys).any() else None
                query, row, score = index.search(_fitted(q, index.width), k, floor, own)
                best = _best(*(np.concatenate(p) for p in zip(best, (query, keys[row], score), strict=True)), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(wanted)) == k)
                floor[full] = np.maximum(floor[full], best[2][np.searchsorted(best[0], full, "right") - 1])
                block[3] = best
    yield from found()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k rows of highest integer inner product.

    Components become floor(scale * x) and should stay under 2**26. A query's own id is no candidate;
    all other rows are. Ties go to the smaller id. Rows whose vector is null or holds a null or
    non-finite component, or whose id is null, take no part; of vectors of different lengths, the
    shorter count as ending in zeros. Rows that repeat an id are candidates of their own; queries
    that repeat one are searched once, by the first of their vectors in ascending order. With fewer than k
    candidates all are returned; an empty table on either side gives none. Columns not named are ignored.

    Rows and queries are packed into blocks of fixed size, and these dealt to a grid of tasks: a task has
    some blocks of queries and some of rows, so that tasks grow in number with either, and the copies of a
    block are as many as the groups of the other side. k rows a query come back from each task.
    """
    rows, asked = quantised(vectors, id_col, vector_col, scale), quantised(queries, id_col, vector_col, scale)
    asked = asked.where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_asked = (max(1, -(-df.count() // size)) for df, size in ((rows, block), (asked, QUERIES)))
    each_rows, each_asked = min(TASK_ROWS, -(-n_rows // TASKS)), min(TASK_QUERIES, n_asked)
    across, down = -(-n_rows // each_rows), -(-n_asked // each_asked)

    place = lambda n, each: F.floor(F.col("number") / each).cast("int")
    rows = _blocks(rows.repartition(n_rows), block, 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asked = _blocks(asked.repartition(n_asked), QUERIES, 0).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    rows = rows.withColumn("cell", place(n_rows, each_rows) * down + F.col("other"))
    asked = asked.withColumn("cell", F.col("other") * down + place(n_asked, each_asked))
    cells = rows.unionByName(asked).select("cell", "kind", "number", "ids", "size", "x")
    cells = cells.repartitionById(across * down, F.col("cell")).sortWithinPartitions("cell", "kind", "number")
    found = cells.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
