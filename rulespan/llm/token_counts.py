"""Exact token counts by the tokenizers library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text, _vocab


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; only lengths leave Python.

    Arrow batches are taken in runs of about equal bytes, and longer texts in parts cut at safe
    places, so memory is bounded by the longest text. ``vocabulary`` is the path of a byte-level
    BPE file that every executor has; no special tokens are added, and those in a text count as the
    library counts them. ``over_limit`` is ``n_tokens > limit``.

    A null text counts as empty (0, 0, false). A null id stays null, repeated rows are each counted,
    other columns are ignored, and an empty table gives none.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _vocab.spaced_counts(vocabulary)
        for batch in batches:
            texts = _text.column(batch, 1)
            for a, b in _text.by_bytes(texts):
                n_bytes = [len(t) if t else 0 for t in texts[a:b]]
                n_tokens = [counts.count(t.decode()) if t else 0 for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
