"""Exact Jaccard self-join on word shingles, as links between classes of equal sets and their components.

If two sets reach the similarity J, each holds a common shingle among its first n - ceil(J n) + 1 in
any order that holds for all sets. The order here takes shingles that many documents share last, so that
a passage found everywhere brings few tiles. Of the sets that hold such a shingle the least one is the
hub; sets meet in tiles of one hub and one band of sizes. A hub stands for all shingles whose least set it
is, so a passage of many words brings few tiles, and a set travels once to each. Within a tile, hashed
bitmaps bound the overlap of two sets from above by bit counts; pairs that the bound leaves are decided
by intersecting the sorted arrays.

Classes of equal sets are held once. Each set is first compared with its hubs only; what these links join
needs no further comparison. Sets of one tile that are still apart are compared pair by pair, in tiles of
bounded size: first a few pairs between any two components, which joins most of those that are one, then
all pairs that are left in tiles of hubs where pairs were held back. So no link between different sets is lost, though links inside a component need
not all be listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, least_nodes
from ..session import Scratch
from . import _text
from ._spread import join_spread

WORDS = 5
#: Rows on each side of a tile.
TILE = 2048
#: Pairs between two components that each task of the first of two such rounds gives on.
FEW = 4
#: Pairs, or sets, that a task remembers at most; others may be given again, from another tile.
PAIRS_KEPT = 250_000
#: A shingle in so many documents of one slice is reported; so many in all make it common.
REPORTED, COMMON = 3, 24
#: Links up to which components are found by the driver, 16 bytes each; more go through rounds of joins.
FEW_LINKS = 100_000
#: Pairs up to which the ids of their documents are broadcast; of more, the texts are shuffled.
FEW_PAIRS = 1_000_000
#: Common shingles that are put last at most. Any order gives the same links; others stay in place.
COMMON_KEPT = 300_000


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each set begins (and the last ends)."""
    h, ends = _text.hashed([t.lower() if t else t for t in texts])
    lengths = np.diff(ends)
    counts = np.where(lengths < words, np.minimum(lengths, 1), lengths - words + 1)
    cut = np.concatenate([[0], np.cumsum(counts)])
    values, grams = np.empty(cut[-1], _text.U64), _text.grams(h, words, 5)
    for a, b, first, n in zip(cut[:-1].tolist(), cut[1:].tolist(), ends[:-1].tolist(), lengths.tolist(), strict=True):
        if n >= words:
            values[a:b] = np.sort(grams[first : first + b - a])
        elif n:  # fewer words make one shingle
            values[a] = xxhash.xxh3_64_intdigest(h[first : first + n].tobytes(), seed=n)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[cut[:-1][counts > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[cut]


def signature(values: np.ndarray, doubtful: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """Of a whole set; one that different sets share, a ``doubtful`` one, gives way to another of each."""
    first = (xxhash.xxh3_64_intdigest(values.tobytes()) >> (64 - bits)) - (1 << 63)
    return second_signature(values) if first in doubtful else first


def second_signature(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes(), seed=1) - (1 << 63)


def bitmap(values: np.ndarray) -> np.ndarray:
    """A bit for each shingle, in two to four times as many bits as there are shingles; as bytes."""
    bits = 64 << max(0, (2 * len(values) - 1).bit_length() - 6)
    out = np.zeros(bits, np.uint8)
    out[(values & _text.U64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def bound(n_a: int, bits_a: np.ndarray, n_b: int, bits_b: np.ndarray) -> int:
    """At most so many shingles are common: each bit that only one side has is a shingle that only it has."""
    size = min(len(bits_a), len(bits_b))
    a, b = _fold(bits_a, size), _fold(bits_b, size)
    return min(n_a - int(_COUNTS[a & ~b].sum()), n_b - int(_COUNTS[b & ~a].sum()))


class Similarity:
    """J as a fraction: common * den >= num * union."""

    def __init__(self, at_least: Fraction):
        self.num, self.den = at_least.numerator, at_least.denominator

    def linked(self, common: int, n_a: int, n_b: int) -> bool:
        return common * self.den >= self.num * (n_a + n_b - common)

    def prefix(self, n: int) -> int:
        return n - ceil(Fraction(n * self.num, self.den)) + 1

    def band(self, n: int) -> int:
        """Sets that can link have the same band or neighbouring ones."""
        k = 0
        while n > 1:
            n = n * self.num // self.den
            k += 1
        return k


def _array(df: DataFrame, name: str) -> np.ndarray:
    return np.sort(df.select(name).toArrow().column(0).to_numpy().astype(np.int64).view(_text.U64))


def link_components(spark: SparkSession, docs: DataFrame, at_least: Fraction = Fraction(3, 4), words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", signature_bits: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row.

    A-Z are lower-cased; words are runs of characters other than ASCII white space; a set holds the
    distinct runs of ``words`` words, or the whole sequence if it is shorter. Two rows link if their
    sets' Jaccard similarity is ``at_least``. ``component_id`` is the least id that links lead to, the
    row's own included. Shingles are told apart by 64-bit hashes, sets by two: where different sets share the
    first, of ``signature_bits`` bits, as a few of 10**10 do, they go by the second.

    A null text, or one without words, has an empty set, links with nothing and is its own component.
    A null id is never the least; a component of null ids only has a null component_id. Rows that
    repeat an id count as rows of their own. Columns not named are ignored; an empty table gives none.
    """
    _text.small_batches(spark)
    sim = Similarity(at_least)
    scratch = Scratch(spark, "jaccard", release=True)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for each shingle that is frequent in a slice."""
        for batch in batches:
            texts, ids = _text.column(batch, 1), batch.column(0)
            for a, b in _text.by_bytes(texts):
                values, cut = shingle_sets(texts[a:b], words)
                full = [values[cut[i] : cut[i + 1]] if cut[i + 1] > cut[i] else None for i in range(b - a)]
                sigs = [None if v is None else signature(v, bits=signature_bits) for v in full]
                seconds = [None if v is None else second_signature(v) for v in full]
                frequent, times = np.unique(values, return_counts=True)
                frequent, times = frequent[times >= REPORTED], times[times >= REPORTED]
                k = len(frequent)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.slice(a, b - a), pa.nulls(k, pa.int64())]),
                        pa.array([*np.diff(cut).tolist(), *times.tolist()], pa.int64()),
                        pa.concat_arrays([pa.array(sigs, pa.int64()), pa.array(_text.signed(frequent))]),
                        pa.array(seconds + [None] * k, pa.int64()),
                        pa.array([True] * (b - a) + [False] * k),
                        pa.array([None if v is None else bitmap(v).tobytes() for v in full] + [None] * k, pa.binary()),
                    ],
                    names=["doc_id", "n", "sig", "second", "is_doc", "bits"],
                )

    seen = scratch.put(source.mapInArrow(_text.tidy(survey), "doc_id long, n long, sig long, second long, is_doc boolean, bits binary"), "survey")
    shared = seen.where("is_doc and sig is not null").groupBy("sig").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo <> hi")
    doubtful = frozenset(r[0] for r in shared.select("sig").collect())  # about n * n / 2**65 of n sets
    if doubtful:
        apart = spark.createDataFrame([(x,) for x in doubtful], "sig long").withColumn("shared", F.lit(True))
        seen = seen.join(F.broadcast(apart), "sig", "left").withColumn("sig", F.when(F.col("is_doc") & F.col("shared"), F.col("second")).otherwise(F.col("sig"))).drop("shared")
    members = seen.where("is_doc").select("doc_id", "n", "sig")
    common = seen.where("not is_doc").groupBy("sig").agg(F.sum("n").alias("n")).where(f"n >= {COMMON}").orderBy(F.desc("n"), "sig").limit(COMMON_KEPT)
    last = spark.sparkContext.broadcast(_array(common, "sig"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # sets that this task has given already, as far as it remembers
        for batch in batches:
            texts = _text.column(batch, 0)
            for a, b in _text.by_bytes(texts):
                values, cut = shingle_sets(texts[a:b], words)
                frequent = np.zeros(len(values), bool)
                if len(last.value):
                    at = np.minimum(np.searchsorted(last.value, values), len(last.value) - 1)
                    frequent = last.value[at] == values
                tokens, sigs, bands = [], [], []
                for i in range(b - a):
                    own = values[cut[i] : cut[i + 1]]
                    if not len(own) or (sig := signature(own, doubtful, signature_bits)) in done:
                        continue
                    if len(done) < PAIRS_KEPT:
                        done.add(sig)
                    f = frequent[cut[i] : cut[i + 1]]
                    p = sim.prefix(len(own))
                    rare = own[~f][:p]
                    tokens.append(np.concatenate([rare, own[f][: p - len(rare)]]))
                    sigs.append(np.full(p, sig, np.int64))
                    bands.append(np.full(p, sim.band(len(own)), np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(_text.signed(np.concatenate(tokens))), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(bands))], names=["token", "sig", "band"])

    given = source.where("text is not null").select("text").mapInArrow(_text.tidy(prefixes), "token long, sig long, band int")
    # Sets that share a token share its least set too, so tokens of one least set make one tile.
    holders = Window.partitionBy("token")
    shared = given.repartition("token").distinct().withColumns({"hub": F.min("sig").over(holders), "most": F.max("sig").over(holders)}).where("hub < most")
    tiles = scratch.put(shared.select("hub", "sig", "band").distinct(), "tiles")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.column(batch, 0)
            for a, b in _text.by_bytes(texts):
                values, cut = shingle_sets(texts[a:b], words)
                full = [values[cut[i] : cut[i + 1]] for i in range(b - a) if cut[i] < cut[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([signature(v, doubtful, signature_bits) for v in full], pa.int64()), pa.array([v.tobytes() for v in full], pa.binary())],
                    names=["sig", "shingles"],
                )

    # What bounds the overlap of the sets that meet any other, and the document that gives such a set.
    met = tiles.select("sig").distinct()
    size = seen.where("is_doc and sig is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("doc")).join(met, "sig", "left_semi")
    size = scratch.put(size, "sizes")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            ba, bb = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            ok = [sim.linked(min(x, y), x, y) and sim.linked(bound(x, np.frombuffer(p, np.uint8), y, np.frombuffer(q, np.uint8)), x, y) for x, y, p, q in zip(na, nb, ba, bb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1, 6, 7)], names=["a", "b", "a_doc", "b_doc"]).filter(pa.array(ok, pa.bool_()))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            arrays = ((np.frombuffer(x, _text.U64), np.frombuffer(y, _text.U64)) for x, y in pairs)
            ok = [sim.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("sig").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in df.columns[1:]])

    def decide(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, of written ones. Sorted arrays are made only for sets of pairs that the bound left, from their least document."""
        wanted = pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("doc_id")).distinct()
        if pairs.count() <= FEW_PAIRS:
            wanted = F.broadcast(wanted)
        nameless = source.where("doc_id is null and text is not null").select("text")
        chosen = source.join(wanted, "doc_id", "left_semi").select("text").unionByName(nameless).distinct()
        body = scratch.put(chosen.mapInArrow(_text.tidy(sets), "sig long, shingles binary"), f"{name}-sets")
        full = pairs.select("a", "b").join(side(body, "a"), "a").join(side(body, "b"), "b").select("a", "b", "a_shingles", "b_shingles")
        linked = scratch.put(full.mapInArrow(_text.tidy(decided), "a long, b long"), name)
        scratch.drop(f"{name}-sets")
        return linked

    star = tiles.where("sig <> hub").select(F.col("hub").alias("a"), F.col("sig").alias("b"))
    star = star.join(side(size, "a"), "a").join(side(size, "b"), "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits", "a_doc", "b_doc").mapInArrow(_text.tidy(bounded), "a long, b long, a_doc long, b_doc long")
    links = decide(scratch.put(star, "star-bounded"), "star")

    def components(links: DataFrame, name: str) -> DataFrame:
        if links.count() > FEW_LINKS:
            return scratch.put(connected_components(spark, links), name)
        node, root = least_nodes(*(c.to_numpy() for c in links.toArrow().columns))
        return scratch.put(spark.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})), name)

    joined = components(links, "joined")

    def in_tiles(tiles: DataFrame, joined: DataFrame, name: str) -> DataFrame:
        """Rows of the tiles whose sets are still apart; each pair of bands and parts is one tile of bounded size."""
        rows = tiles.join(joined.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        # A set stands in its own band's tile, and in the next band's as the smaller side.
        rows = rows.withColumn("low", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") + F.col("low")).select("hub", "band", "low", "sig", "root")
        rows = scratch.put(rows, f"{name}-apart")
        mixed = rows.groupBy("hub", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("low").alias("side"), F.count(F.lit(1)).alias("rows"))
        mixed = scratch.put(mixed.where("lo < hi and side = 0").select("hub", "band", F.ceil(F.col("rows") / TILE).cast("int").alias("parts")), f"{name}-mixed")
        rows = rows.join(mixed, ["hub", "band"]).withColumn("part", F.pmod(F.xxhash64("sig", "hub"), F.col("parts")).cast("int"))
        others = F.sequence(F.lit(0), F.col("parts") - 1)
        # Parts i of the larger side meet parts j of either.
        place = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
        larger = F.concat(F.transform(others, lambda o: place(F.col("part"), o, False)), F.transform(F.filter(others, lambda o: o < F.col("part")), lambda o: place(o, F.col("part"), True)))
        rows = rows.withColumn("at", F.explode(F.when(F.col("low") == 0, larger).otherwise(F.transform(others, lambda o: place(o, F.col("part"), True)))))
        rows = rows.select("hub", "sig", "root", "band", "at.i", "at.j", "at.right")
        filled = rows.join(size, "sig")
        lanes = filled.repartition("hub", "band", "i", "j").sortWithinPartitions("hub", "band", "i", "j", "right")
        return lanes.select("hub", "band", "i", "j", "right", "sig", "root", "n", "bits", "doc")

    def compare(batches: Iterator[pa.RecordBatch], few: int | None = None) -> Iterator[pa.RecordBatch]:
        """Pairs of one tile that the bound leaves, between sets that are still apart, and their documents.

        With ``few``, only so many of two components; a hub of which pairs were held back comes as a row with a null ``b``.
        """
        tile, left, right, docs = None, [], [], {}
        given: set[tuple] = set()
        held: set[int] = set()
        between: dict[tuple[int, int], int] = {}

        def wanted(p: int, q: int) -> bool:
            if few is None:
                return True
            key = (p, q) if p < q else (q, p)
            between[key] = between.get(key, 0) + 1
            if between[key] > few:
                held.add(tile[0])
            return between[key] <= few

        def blocks(rows: list) -> list[tuple[np.ndarray, ...]]:
            """Rows of equally long bitmaps, side by side."""
            by: dict[int, list] = {}
            for row in rows:
                by.setdefault(len(row[3]), []).append(row)
            return [(*(np.array([r[k] for r in rs], np.int64) for k in range(3)), np.stack([r[3] for r in rs]).view(_text.U64)) for rs in by.values()]

        def against(x: tuple, block: tuple[np.ndarray, ...], above: int | None = None) -> list[int]:
            """The sets of a block that may link with x and are apart from it."""
            sigs, roots, n, bits = block
            on = np.flatnonzero((roots != x[1]) & (np.minimum(n, x[2]) * (sim.den + sim.num) >= sim.num * (n + x[2])))
            if above is not None:
                on = on[sigs[on] > above]
            if not len(on):
                return []
            own, bits, n = x[3].view(_text.U64), bits[on], n[on]
            own = _fold(own, bits.shape[1])
            while bits.shape[1] > len(own):
                half = bits.shape[1] // 2
                bits = bits[:, :half] | bits[:, half:]
            most = np.minimum(n - np.bitwise_count(bits & ~own).sum(1, dtype=np.int64), x[2] - np.bitwise_count(own & ~bits).sum(1, dtype=np.int64))
            on = on[most * (sim.den + sim.num) >= sim.num * (n + x[2])]
            return [y for y, root in zip(sigs[on].tolist(), roots[on].tolist(), strict=True) if wanted(x[1], root)]

        def pairs() -> list[tuple[int, int, int | None, int | None]]:
            same = tile is not None and tile[2] == tile[3]
            inner, outer = blocks(left) if same else [], blocks(right) if left else []
            # Of pairs inside a tile each is met from both sides; the one with the lesser set first counts.
            out = [(x[0], y) for x in left for block in inner for y in against(x, block, x[0])]
            out += [(min(x[0], y), max(x[0], y)) for x in left for block in outer for y in against(x, block)]
            return [(x, y, docs[x], docs[y]) for x, y in out]

        def listed(found: set[tuple[int, int, int | None, int | None]]) -> pa.RecordBatch:
            found -= given
            if len(given) < PAIRS_KEPT:
                given.update(found)
            rows = [*found, *((hub, None, None, None) for hub in held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 4)], names=["a", "b", "a_doc", "b_doc"])

        for batch in batches:
            found: set[tuple[int, int, int | None, int | None]] = set()
            for hub, band, i, j, is_right, sig, root, n, bits, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != (hub, band, i, j):
                    found.update(pairs())
                    tile, left, right, docs = (hub, band, i, j), [], [], {}
                docs[sig] = doc
                (right if is_right else left).append((sig, root, n, np.frombuffer(bits, np.uint8)))
            yield listed(found)
        yield listed(set(pairs()))

    for name, few in (("few", FEW), ("all", None)):
        met = in_tiles(tiles, joined, name).mapInArrow(_text.tidy(partial(compare, few=few)), "a long, b long, a_doc long, b_doc long").distinct()
        met = scratch.put(met, f"{name}-bounded")
        links = links.unionByName(decide(met.where("b is not null"), name))
        joined = components(links, f"joined-{name}")
        scratch.drop(f"{name}-apart")
        # Where no pair was held back, all have been given.
        held = met.where("b is null").select(F.col("a").alias("hub")).distinct()
        if not held.take(1):
            break
        tiles = tiles.join(held, "hub", "left_semi")
    roots = joined

    # Least ids are found for classes; a class or component of a third of all rows is joined without one task for it.
    classes = members.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("rows")).join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    classes = scratch.put(classes.withColumn("root", F.coalesce("root", "sig")), "classes")
    least = classes.groupBy("root").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("held"))
    named = join_spread(classes, least, ["root"], "held", "sig").select("sig", "least", "rows")
    final = join_spread(members.withColumn("salt", F.monotonically_increasing_id()), named, ["sig"], "rows", "salt")
    out = final.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    for name in ("tiles", "sizes"):
        scratch.drop(name)
    return out
