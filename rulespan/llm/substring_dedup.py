"""Removal of word sequences that occurred before, by seed and extend.

Seeds are winnowed anchors (Schleimer et al., 2003): of every run of GRAM-word grams that a window of
``min_words`` words holds, the least hash. Equal windows have equal anchors, so documents are joined
on anchors first. Neighbouring windows of one anchor make a run; each run is hashed as a whole. A run
of which all is found under its anchor in an earlier document is a match in one piece. Only where an
anchor has runs that differ, the first document of each extends them both ways: it gives the run's
windows one by one, and these are matched. Runs that lie in later copies need not be opened, as the
first document with the same run stands for them. A match is kept where it reaches ``min_words``;
neighbouring windows that match make up a maximal repeat. Runs are told apart by 128 bits (with their
anchor's), windows by 96.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from . import _text

GRAM = 6


def _anchors(h: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """The anchor of each window that begins at ``at``."""
    return _text.sliding(_text.grams(h, GRAM, 7), min_words - GRAM + 1)[at] if len(at) else np.empty(0, _text.U64)


def _windows(h: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """Hash of the window at each place, from grams that cover it."""
    if not len(at):
        return np.empty(0, _text.U64)
    grams = _text.grams(h, GRAM, 11)
    out = np.full(len(at), min_words, _text.U64)
    for k in sorted({*range(0, min_words - GRAM, GRAM), min_words - GRAM}):
        out = _text.mixed(out * _text.U64(0x9E3779B97F4A7C15) + grams[at + k])
    return out


def _runs(h: np.ndarray, at: np.ndarray, text: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: the index of its first window in ``at``, how many windows, its anchor and its hash."""
    anchors = _anchors(h, at, min_words)
    change = np.ones(len(at), bool)
    change[1:] = (text[1:] != text[:-1]) | (anchors[1:] != anchors[:-1])
    begin = np.flatnonzero(change)
    n = np.diff(np.append(begin, len(at)))
    inside = (np.arange(len(at)) - np.repeat(begin, n)).astype(_text.U64)
    hashes = np.add.reduceat(_text.mixed(_windows(h, at, min_words) + inside * _text.U64(0xD6E8FEB86659FD93)), begin)
    return begin, n, anchors[begin], hashes


def _first(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first place of each pair of text and value; ``text`` ascends."""
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return order[new]


def remove_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed`` and ``kept_text`` (if ``with_text``) for each row.

    Words are runs of characters other than ASCII white space, unchanged. A window is ``min_words``
    consecutive words of one row. Every word is removed that lies in a window whose words also begin
    earlier: in a row of smaller id, or earlier in the same row. Windows are judged on the input.
    ``removed`` lists the maximal removed runs as (start, length) in words; kept words are joined by
    one space.

    A null text has no words. Rows with a null id neither remove from others nor lose words to them,
    only repeats within themselves. Rows that repeat an id are judged as one place: they don't remove
    from each other, only from later ids; with equal texts each comes back. Columns not named are
    ignored; an empty table gives none.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows that repeat an id with another text stay apart.
    keyed = source.withColumn("key", F.xxhash64("doc_id", "text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, ids = _text.column(batch, 2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _text.by_bytes(texts):
                h, ends = _text.hashed(texts[a:b])
                at, text = _text.places(ends, min_words)
                if not len(at):
                    continue
                begin, n, anchors, hashes = _runs(h, at, text, min_words)
                first = _first(text[begin], hashes)
                t = text[begin[first]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_text.signed(anchors[first])), pa.array(_text.signed(hashes[first])), pa.array(keys[a:b][t]), pa.array(ids[a:b][t]), pa.array((at[begin[first]] - ends[:-1][t]).astype(np.int32)), pa.array(n[first].astype(np.int32))],
                    names=["anchor", "run", "key", "doc_id", "start", "n"],
                )

    usable = keyed.where("doc_id is not null and text is not null").select("key", "doc_id", "text")
    # Each step is written, so that it is computed once and what it shuffled can be given up.
    scratch = Scratch(docs.sparkSession, "repeats", release=True)
    runs = scratch.put(usable.mapInArrow(seeds, "anchor long, run long, key long, doc_id long, start int, n int"), "runs")
    anchors = runs.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("run").alias("lo"), F.max("run").alias("hi"))
    anchors = scratch.put(anchors.where("first < last").select("anchor", "first", F.expr("lo = hi").alias("alone")), "anchors")
    # Under an anchor with equal runs only, the first document's run is no repeat and needs no more.
    shared = scratch.put(runs.join(anchors, "anchor").where("not (alone and doc_id = first)").drop("first"), "shared")
    scratch.drop("runs")
    owners = scratch.put(shared.where("not alone").groupBy("anchor", "run").agg(F.min("doc_id").alias("owner")), "owners")
    span, is_open = F.struct("start", "n"), F.col("doc_id") == F.col("owner")
    judged_runs = shared.join(owners, ["anchor", "run"], "left").withColumn("open", F.coalesce(is_open, F.lit(False)))
    parts = judged_runs.groupBy("doc_id", "key").agg(F.collect_list(F.when(F.col("open"), span)).alias("open"), F.collect_list(F.when(~F.col("open"), span)).alias("gone"))
    parts = scratch.put(parts, "parts")
    scratch.drop("shared")

    def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of all rows' spans, and where each row's begin."""
        flat = column.values
        return flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64), column.offsets.to_numpy()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, ids = _text.column(batch, 2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts, lengths, cut = spans(batch.column(3))
            for a, b in _text.by_bytes(texts):
                h, ends = _text.hashed(texts[a:b])
                lo, hi = cut[a], cut[b]
                text = np.repeat(np.repeat(np.arange(b - a), np.diff(cut[a : b + 1])), lengths[lo:hi])
                inside = np.arange(len(text)) - np.repeat(np.cumsum(lengths[lo:hi]) - lengths[lo:hi], lengths[lo:hi])
                at = ends[:-1][text] + np.repeat(starts[lo:hi], lengths[lo:hi]) + inside
                order = np.argsort(at)
                at, text = at[order], text[order]
                anchors = _anchors(h, at, min_words)
                values = _windows(h, at, min_words)
                first = _first(text, values)
                t = text[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_text.signed(values[first])), pa.array(_text.signed(anchors[first]).astype(np.int32)), pa.array(keys[a:b][t]), pa.array(ids[a:b][t]), pa.array((at[first] - ends[:-1][t]).astype(np.int32))],
                    names=["window", "check", "key", "doc_id", "start"],
                )

    matched = keyed.join(parts.where("size(open) > 0").drop("gone"), ["doc_id", "key"]).select("key", "doc_id", "text", "open")
    windows = scratch.put(matched.mapInArrow(extend, "window long, check int, key long, doc_id long, start int"), "windows")
    earliest = windows.groupBy("window", "check").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    earliest = scratch.put(earliest, "earliest")
    later = windows.join(earliest, ["window", "check"]).where("doc_id > first_id").groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    later = scratch.put(later, "later")
    scratch.drop("windows")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, starts_of = _text.column(batch, 1), batch.column(0), batch.column(2).to_pylist()
            run_starts, run_lengths, cut = spans(batch.column(3))
            for a, b in _text.by_bytes(texts):
                h, ends = _text.hashed(texts[a:b])
                at, text = _text.places(ends, min_words)
                gone = np.zeros(len(h) + 1, np.int32)
                if len(at):
                    values = _windows(h, at, min_words)
                    first = _first(text, values)
                    local = np.ones(len(at), bool)
                    local[first] = False
                    begin = [at[local]]
                    begin += [ends[i] + np.array(s, np.int64) for i, s in enumerate(starts_of[a:b]) if s]
                    begin = np.concatenate(begin)
                    of = np.repeat(np.arange(b - a), np.diff(cut[a : b + 1]))
                    more = ends[:-1][of] + run_starts[cut[a] : cut[b]]
                    np.add.at(gone, np.concatenate([begin, more]), 1)
                    np.add.at(gone, np.concatenate([begin, more + run_lengths[cut[a] : cut[b]] - 1]) + min_words, -1)
                gone = np.cumsum(gone) > 0
                out: list[list] = [[], [], [], [], []]
                for i, body in enumerate(texts[a:b]):
                    lo, hi = int(ends[i]), int(ends[i + 1])
                    mask = gone[lo:hi]
                    words = body.split() if body else []
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                    if len(edge):
                        words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                    kept = b" ".join(words)
                    for c, v in zip(out, (hi - lo, int(mask.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(s), "length": int(e - s)} for s, e in edge.reshape(-1, 2)], kept.decode() if with_text else None), strict=True):
                        c.append(v)
                run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], run), pa.array(out[4], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"],
                )

    judged = keyed.join(parts.drop("open"), ["doc_id", "key"], "left").join(later, ["doc_id", "key"], "left").select("doc_id", "text", "starts", "gone")
    out = judged.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:bigint,length:bigint>>, kept_text string")
    return out if with_text else out.drop("kept_text")
