"""Benchmark passages in documents, by SimHash of item-sized windows; DataFrame functions only.

A document's windows that share no shingle with a benchmark item have similarity 0 to all items, so
only windows over a shared shingle are fingerprinted: windows of the item's own number of words. The
fingerprint has 63 bits, each the majority of one bit of the words' hashes. Multi-index hashing (Norouzi
et al., 2012) cuts it into five blocks; within Hamming distance 14, one block at least is within 2, so
looking up each block with all its neighbours within 2 finds every pair in the radius. Candidates are
decided by the exact weighted (multiset) Jaccard similarity of their word shingles.

The counters of a fingerprint hold 120 words. A longer item is looked up by its parts of so many words; where a
window matches a part, the window of the whole item's length that is aligned with it is decided exactly.

A document of fewer words than the item is one window itself. Fingerprints of different lengths lie too
far apart for the radius, so such a pair is found by prefix filtering instead (Chaudhuri et al., 2006): at a
similarity of t, one at least of any (1 - t) |item| + 1 shingles of the item is in the document; the
rarest are looked up. An item of fewer words than a shingle is met by documents of the same words only.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

# Arrays are exploded by explode_outer() where their expression is large: for explode(), Spark would
# add a filter on the array's size and push it below the columns that the expression uses, and so
# compute these again for every element.

SHINGLE = 5
RADIUS, NEAR = 14, 2
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 12), (51, 12))
#: Stands for a block where a document shorter than the item is looked up by shingle.
BY_SHINGLE = len(BLOCKS)
#: Counters of eight bits hold so many words; longer items are cut into parts of this many.
PART_WORDS = 120
#: Bytes of an item table up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64_000_000

_ONES, _PICK, _SEVEN, _HIGH = 0x0001010101010101, 0x0040201008040201, 0x007F7F7F7F7F7F7F, 0x0080808080808080


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _shingles(h: Column) -> Column:
    n = F.size(h) - SHINGLE
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)])))


def _counters(h: Column, k: int) -> Column:
    """Bits 7k to 7k + 6 of each hash, in seven counters of eight bits."""

    def spread(x: Column) -> Column:
        bits = F.shiftrightunsigned(x, 7 * k).bitwiseAND(F.lit(127).cast("long"))
        picked = (bits * F.lit(_ONES)).bitwiseAND(F.lit(_PICK))
        return F.shiftrightunsigned((picked + F.lit(_SEVEN)).bitwiseAND(F.lit(_HIGH)), 7)

    return F.transform(h, spread)


def _fingerprint(counters: list[Column], start: Column, m: Column) -> Column:
    """Of m words from ``start`` (0-based) on. Each step has its own lambda, so that no sum is taken twice."""
    sums = F.array(*[F.aggregate(F.slice(c, start + 1, m), F.lit(0).cast("long"), lambda a, x: a + x) for c in reversed(counters)])
    half = (F.lit(127) - F.floor(m / 2)).cast("long") * F.lit(_ONES)
    high = F.transform(sums, lambda t: F.shiftrightunsigned((t + half).bitwiseAND(F.lit(_HIGH)), 7))
    high = F.transform(high, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 7)))  # bits 0, 8, ... 48 move together
    high = F.transform(high, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 14)))
    high = F.transform(high, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 28)))
    return F.aggregate(high, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 7).bitwiseOR(x.bitwiseAND(F.lit(127).cast("long"))))


def _blocks(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for at, n in BLOCKS]


def _masks(n: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(NEAR + 1) for c in combinations(range(n), r)]


def _neighbours(k: int, block: Column, size: int) -> Column:
    """All values within NEAR of block number k."""
    masks = F.array(*[F.lit(x).cast("long") for x in _masks(size)])
    return F.transform(masks, lambda x: F.struct(F.lit(k).alias("block"), block.bitwiseXOR(x).alias("value")))


def _similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater counts of each shingle: one pass over both, sorted together."""
    both = F.sort_array(F.concat(F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(0).alias("side"))), F.transform(b, lambda x: F.struct(x.alias("x"), F.lit(1).alias("side")))))
    zero = F.lit(0)
    start = F.struct(F.lit(None).cast("long").alias("x"), zero.alias("a"), zero.alias("b"), zero.alias("common"))

    def step(s: Column, e: Column) -> Column:
        same = s["x"].eqNullSafe(e["x"])
        return F.struct(
            e["x"].alias("x"),
            (F.when(same, s["a"]).otherwise(0) + 1 - e["side"]).alias("a"),
            (F.when(same, s["b"]).otherwise(0) + e["side"]).alias("b"),
            (s["common"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))).alias("common"),
        )

    common = F.aggregate(both, start, step, lambda s: s["common"] + F.least(s["a"], s["b"]))
    return F.transform(F.array(common), lambda c: c / (F.size(a) + F.size(b) - c))[0]


def _small(df: DataFrame, arrays: tuple[str, ...] = ()) -> DataFrame:
    """Broadcast only if its size in bytes has been checked."""
    width = reduce(lambda n, c: n + 8 * F.coalesce(F.size(c), F.lit(0)), arrays, F.lit(64)).cast("long")
    most = BROADCAST_BYTES // 64 + 1
    total = df.limit(most).agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def item_parts(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, m, whole, at, shingles, h, all`` of each item, or of each part of a longer one.

    A part has m words from ``at`` on, of the item's ``whole`` number of words; the last part ends with the item.
    ``all`` has the shingles of a whole item of several parts, and is null otherwise.
    """
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") >= SHINGLE)
    rows = rows.select("item_id", _hashes(F.col("w")).alias("w"))
    n = F.size("w")
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PART_WORDS).cast("int")), lambda k: F.greatest(F.lit(0), F.least(k * PART_WORDS, n - PART_WORDS))))
    parts = rows.withColumn("all", F.when(n > PART_WORDS, _shingles(F.col("w")))).withColumn("at", F.explode_outer(starts))
    parts = parts.select("item_id", n.alias("whole"), "at", "all", F.slice("w", F.col("at") + 1, F.lit(PART_WORDS)).alias("h"))
    return parts.select("item_id", F.size("h").alias("m"), "whole", "at", _shingles(F.col("h")).alias("shingles"), "h", "all").distinct()


def _with_prefix(parts: DataFrame, t: Fraction) -> DataFrame:
    """``parts`` with ``prefix``: so many of the whole item's rarest shingles that a text of similarity t has one of them."""
    own = parts.withColumn("of", F.coalesce("all", "shingles"))
    shared = own.select("item_id", F.explode(F.array_distinct("of")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("held"))
    each = own.select("item_id", "of").distinct().withColumn("x", F.explode("of")).join(shared, "x")
    size = F.size("of")
    n = (size - F.ceil(size * t.numerator / t.denominator - 1e-9) + 1).cast("int")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("held", "x"))), F.lit(1), F.least(n, size))
    return each.groupBy("item_id", "of").agg(rarest.alias("r")).select("item_id", "of", F.array_distinct(F.col("r.x")).alias("prefix"))


def _whole_matches(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str) -> DataFrame | None:
    """Documents of the same words as an item that has fewer than a shingle; None if there is no such item."""
    short = lambda df, names: df.select(*names, F.array_join(words(F.col("text")), " ").alias("w"), F.size(words(F.col("text"))).alias("n")).where(F.col("n").between(1, SHINGLE - 1))
    asked = short(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), ["item_id"])
    asked = asked.select("item_id", "w").distinct()
    if not asked.take(1):
        return None
    found = short(docs, ["doc_id", "key"]).join(_small(asked), "w").select("doc_id", "item_id", F.lit(0).alias("start"), F.col("n").alias("n_words"), F.lit(1.0).alias("similarity"))
    return found.distinct()


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, at_least: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity, n_windows`` for each pair of row and item that match.

    A pair matches if a window of the row, of as many words as the item, has weighted Jaccard
    similarity ``at_least`` on shingles of five words and a fingerprint within 14 of 63 bits. A row of
    fewer words is one window, the whole of it, and matches by similarity alone. ``start`` is the best
    window's first word (the first of equal ones), ``n_words`` its number of words, ``n_windows`` how
    many windows match. For an item of over 120 words, a window of 120 words must have that similarity and
    fingerprint to a part of the item, and then the window of the item's length that begins where the item would
    (or as near as the row allows) must have the similarity to the item; ``n_windows`` counts the latter.

    An item of fewer than five words has no shingle; it matches rows of the same words only, similarity 1. Items
    without words and null texts on either side match nothing. Rows of one id and text give one result, rows of
    one id and different texts one together; a null id is an id like any other, and items likewise. Columns not
    named are ignored; an empty table gives none.
    """
    # What the items give is written: a plan over the documents that holds it all takes much of the driver's memory.
    scratch = Scratch(spark, "items")
    parts = scratch.put(item_parts(items, item_col, item_text_col), "parts")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    keyed = source.withColumn("key", F.xxhash64("text"))
    hashed = lambda df: df.withColumn("h", _hashes(words(F.col("text")))).withColumn("s", _shingles(F.col("h")))

    # Shared shingles: one row for each place of a document and shape of item: words of the part, of the item, place.
    shape = ["m", "whole", "at"]
    wanted = _small(scratch.put(parts.select(*shape, F.explode("shingles").alias("x")).distinct(), "wanted"))
    places = hashed(keyed).select("doc_id", "key", F.posexplode_outer("s").alias("pos", "x"))
    seeds = places.join(wanted, "x").groupBy(F.col("doc_id").alias("seed_doc"), F.col("key").alias("seed_key"), *shape).agg(F.collect_set("pos").alias("seeds"))

    full = hashed(keyed.join(seeds, F.col("doc_id").eqNullSafe(F.col("seed_doc")) & (F.col("key") == F.col("seed_key"))).drop("seed_doc", "seed_key"))
    full = full.select("doc_id", "s", *shape, "seeds", F.size("h").alias("n"), *[_counters(F.col("h"), k).alias(f"c{k}") for k in range(9)])
    m, n, whole = F.col("m"), F.col("n"), F.col("whole")
    # A row shorter than the item can't reach the similarity if the share of its shingles is less.
    full = full.where((whole <= n) | (n - SHINGLE + 1 >= (whole - SHINGLE + 1) * at_least - 1e-9))
    # Shorter than the item: the whole row is the window. Else of the part's length.
    full = full.withColumn("n_words", F.when(whole > n, n).otherwise(m))
    size = F.col("n_words")
    starts = F.when(whole > n, F.array(F.lit(0))).otherwise(F.flatten(F.transform("seeds", lambda p: F.sequence(F.greatest(F.lit(0), F.least(p - m + SHINGLE, n - m)), F.greatest(F.lit(0), F.least(p, n - m))))))
    counters = [F.col(f"c{k}") for k in range(9)]

    def window(at: Column) -> Column:
        aligned = F.greatest(F.lit(0), F.least(at - F.col("at"), n - whole))
        long = F.when((whole > m) & (whole <= n), F.struct(aligned.alias("start"), F.slice("s", aligned + 1, whole - SHINGLE + 1).alias("window")))
        print_ = F.when(whole <= n, _fingerprint(counters, at, size))
        return F.struct(at.alias("start"), F.slice("s", at + 1, size - SHINGLE + 1).alias("window"), print_.alias("fp"), long.alias("long"))

    # Of what an item's part is: one number, and with a block's or shingle's value one hash, so that the broadcast is small.
    number = lambda: (whole.cast("long") * (1 << 36) + F.col("at").cast("long") * (1 << 8) + m).alias("shape")
    door = lambda block, value: F.xxhash64(block, value, "shape")
    windows = full.withColumn("w", F.explode_outer(F.transform(F.array_distinct(starts), window))).where("w is not null").select("doc_id", number(), "n_words", "w.start", "w.window", "w.fp", "w.long")

    item = parts.withColumn("of", F.coalesce("all", "shingles")).join(_with_prefix(parts, Fraction(str(at_least))).withColumnRenamed("item_id", "of_id"), ["of"]).where(F.col("item_id").eqNullSafe(F.col("of_id")))
    item = item.select("item_id", "prefix", number(), F.col("whole").alias("item_whole"), F.col("shingles").alias("item_shingles"), F.col("of").alias("item_of"), _fingerprint([_counters(F.col("h"), k) for k in range(9)], F.lit(0), F.col("m")).alias("item_fp"))
    item = scratch.put(item, "items")
    near = F.flatten(F.array(*[_neighbours(k, block, size) for k, (block, (_, size)) in enumerate(zip(_blocks(F.col("item_fp")), BLOCKS, strict=True))]))
    fixed = ["shape", "item_fp"]
    by_block = item.select(*fixed).distinct().withColumn("e", F.explode_outer(near)).select(door(F.col("e.block"), F.col("e.value")).alias("door"), *fixed)
    by_shingle = item.select(*fixed, F.explode("prefix").alias("value")).select(door(F.lit(BY_SHINGLE), F.col("value")).alias("door"), *fixed).distinct()
    lookup = _small(scratch.put(by_block.unionByName(by_shingle), "lookup")).withColumnRenamed("shape", "item_shape")

    probe = lambda k, b: F.struct(F.lit(k).alias("block"), b.alias("value"))
    shorter = F.col("fp").isNull()
    asked = F.when(shorter, F.transform(F.array_distinct("window"), lambda x: probe(BY_SHINGLE, x))).otherwise(F.array(*[probe(k, b) for k, b in enumerate(_blocks(F.col("fp")))]))
    probes = windows.withColumn("e", F.explode_outer(asked)).withColumn("door", door(F.col("e.block"), F.col("e.value")))
    met = probes.select("doc_id", "shape", "n_words", "start", "window", "fp", "long", "e.block", "e.value", "door").join(lookup, "door").where("shape = item_shape").drop("item_shape", "door")
    met = met.where(shorter | (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS))
    # A pair met in several blocks, or by several shingles, counts in its first only.
    differ = [F.bit_count(a.bitwiseXOR(b)) <= NEAR for a, b in zip(_blocks(F.col("fp")), _blocks(F.col("item_fp")), strict=True)]
    first = reduce(lambda w, k: w.when(differ[k], k), range(1, len(BLOCKS)), F.when(differ[0], 0))
    once = shorter & (F.col("value") == F.get(F.filter("prefix", lambda x: F.array_contains(F.col("window"), x)), F.lit(0)))
    met = met.where(shorter | (F.col("block") == first)).join(_small(item, ("prefix", "item_shingles", "item_of")), fixed).where(~shorter | once)
    # A row shorter than the item is held against all of it; else first against the part.
    met = met.withColumn("similarity", _similarity(F.col("window"), F.when(shorter, F.col("item_of")).otherwise(F.col("item_shingles")))).where(F.col("similarity") >= at_least)
    far = F.col("long").isNotNull()
    exact = F.when(far, _similarity(F.col("long.window"), F.col("item_of"))).otherwise(F.col("similarity"))
    sure = met.select("doc_id", "item_id", F.coalesce("long.start", "start").alias("start"), F.when(far, F.col("item_whole")).otherwise(F.col("n_words")).alias("n_words"), exact.alias("similarity"))
    # Parts that lead to one window, and those of a long item that a shorter row meets, count once.
    sure = sure.where(F.col("similarity") >= at_least).distinct()
    short = _whole_matches(keyed, items, item_col, item_text_col)
    if short is not None:
        sure = sure.unionByName(short)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b")
    out = sure.groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("n_windows"))
    return out.select("doc_id", "item_id", (-F.col("b.back")).cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.round("b.similarity", 6).alias("similarity"), "n_windows")


def drop_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, at_least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no leak (see :func:`find_leaks`).

    Each row is decided by its own text: of rows that share an id, or have none, those with a leak go.
    """
    key = F.concat_ws(":", F.md5(F.col(text_col).cast("string")), F.xxhash64(F.col(text_col)).cast("string"))
    leaks = find_leaks(spark, docs.select(key.alias("__key"), F.col(text_col).alias("__text")), items, at_least, "__key", "__text").select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, key == F.col("__leak"), "left_anti")
