"""Language by compression: the language whose dictionary makes a text smallest.

How far the smallest size must lie below the next depends on the text's length; the margins are fitted
from labelled rows that are in no dictionary (see :func:`fit`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text

UNDETERMINED = "und"
#: A text is compressed in pieces, each against the bare dictionary, so that a long text doesn't become its own.
PIECE_BYTES = 2048
#: Decimals of a score.
DIGITS = 6

#: Margins by least number of bytes, where the labelled rows are too few to fit them. A tie is never accepted.
MARGINS = ((1, 0.0), (8, 0.01), (16, 0.02), (32, 0.03), (128, 0.03), (512, 0.03))
#: Rows of a margin's fit at least, and rows of all languages at most, so that the driver's share is bounded.
FEW_ROWS, MOST_ROWS = 50, 1024
#: Share of a fitted score that is asked for: a lead half as wide as known languages nearly always have.
SAFETY = 0.5


def _compressors(dictionaries: dict[str, bytes], level: int) -> list:
    import zstandard as z

    size = max(map(len, dictionaries.values()), default=0)
    format = z.ZstdCompressionParameters.from_level(level, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, source_size=PIECE_BYTES, dict_size=size)
    return [z.ZstdCompressor(compression_params=format, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)).compress for d in dictionaries.values()]


def _sizes(data: bytes, compressors: list) -> list[int]:
    pieces = [data[k : k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES)]
    return [sum(len(f(p)) for p in pieces) for f in compressors]


def _score(sizes: list[int]) -> float:
    least = sorted(sizes)[:2]
    return 1.0 if len(least) == 1 else 1 - least[0] / least[1]


def _margins(held: list[tuple[str, str]], dictionaries: dict[str, bytes], level: int) -> tuple[tuple[int, float], ...]:
    """For each length, SAFETY of the lesser of the 1st percentile of known languages' scores and the 99th of those left out."""
    names, compressors, out = list(dictionaries), _compressors(dictionaries, level) if dictionaries else [], []
    for k, (low, default) in enumerate(MARGINS):
        high = MARGINS[k + 1][0] if k + 1 < len(MARGINS) else 2 * low
        known, left_out = [], []
        for i, (lang, text) in enumerate(held):
            data = text.encode()[: low + i * 37 % (high - low)]
            if len(data) < low:
                continue
            sizes = _sizes(data, compressors)
            own = names.index(lang)
            if sizes[own] < min((x for k, x in enumerate(sizes) if k != own), default=sizes[own] + 1):
                known.append(_score(sizes))
            if len(names) > 2:
                left_out.append(_score(sizes[:own] + sizes[own + 1 :]))
        if len(known) < FEW_ROWS:
            out.append((low, default))
            continue
        found = [sorted(known)[len(known) // 100]] + ([sorted(left_out)[len(left_out) * 99 // 100]] if left_out else [])
        out.append((low, round(SAFETY * min(found), DIGITS)))
    return tuple(out)


def fit(
    labelled: DataFrame, docs_per_language: int = 64, bytes_per_doc: int = 1024, max_rows: int = 65_536, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: int = 6
) -> tuple[dict[str, bytes], tuple[tuple[int, float], ...]]:
    """A raw-content dictionary for each language, and the least score by number of bytes.

    The bound of the fit: of each language, the ``docs_per_language`` rows of least hash of (id, text), each
    with ``bytes_per_doc`` characters from its middle; with very many languages as many rows fewer as
    ``max_rows`` rows in all allow (and beyond ``max_rows`` languages, the most frequent ones). The rows next in
    order, up to as many and MOST_ROWS in all, are for the margins: each is scored once among all languages
    and once without its own. Rows without language or without a letter take no part.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    rows = rows.select("l", F.xxhash64("i", F.md5("t")).alias("h"), F.lower(F.substring("t", F.greatest(F.lit(1), F.floor(F.length("t") / 2 - bytes_per_doc / 2).cast("int")), F.lit(bytes_per_doc))).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    # The most frequent language comes first.
    langs = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(max_rows)
    docs_per_language = max(1, min(docs_per_language, max_rows // max(1, langs.count())))
    picked = rows.withColumn("r", rank).where(F.col("r") <= 2 * docs_per_language)
    out: dict[str, list[str]] = {}
    held: list[tuple[str, str]] = []
    found = sorted(picked.join(F.broadcast(langs), "l").select((-F.col("count")).alias("c"), "l", "r", "t").collect())
    each = max(1, MOST_ROWS // max(1, len({r["l"] for r in found})))
    for r in found:
        if r["r"] <= docs_per_language:
            out.setdefault(r["l"], []).append(r["t"])
        elif r["r"] <= docs_per_language + each:
            held.append((r["l"], r["t"]))
    # What stands last in a dictionary is cheapest to refer to; all have one size.
    whole = {k: "\n".join(v).encode() for k, v in out.items()}
    size = min((len(v) for v in whole.values()), default=0)
    dictionaries = {k: v[-max(size, 16_384) :] for k, v in whole.items()}
    return dictionaries, _margins(held[:MOST_ROWS], dictionaries, level)


def train_dictionaries(labelled: DataFrame, *args, **kwargs) -> dict[str, bytes]:
    """The dictionaries of :func:`fit`."""
    return fit(labelled, *args, **kwargs)[0]


class Classifier:
    """Guesses a language; sent to tasks, which make the compressors."""

    def __init__(self, dictionaries: dict[str, bytes], margins: tuple[tuple[int, float], ...] = MARGINS, level: int = 6):
        self.dictionaries, self.margins, self.level = dictionaries, margins, level
        self.names = list(dictionaries)
        self.made: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "made": None}

    def guess(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, whether it is accepted."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        if self.made is None:
            self.made = _compressors(self.dictionaries, self.level)
        data = text.lower().encode()
        sizes = _sizes(data, self.made)
        score = round(_score(sizes), DIGITS)
        return self.names[sizes.index(min(sizes))], score, score > 0 and score >= [m for low, m in self.margins if low <= len(data)][-1]

    def column(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        found = [self.guess(t) for t in texts.to_pylist()]
        return tuple(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margins: tuple[tuple[int, float], ...] = MARGINS, level: int = 6, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for each row, and the columns in ``keep``.

    A text is lower-cased and cut into pieces of 2,048 bytes; the sizes of all its pieces are summed
    for each language. ``score`` is the share by which the smallest sum is below the next one (1 if
    there is one language only). A score under the margin for the text's number of bytes is too narrow, and the
    row isn't ``accepted``; ``lang_pred`` is still the best guess. Ties go to the dictionary that comes first, of
    the most frequent language, and are never accepted.

    A null text, or one without a letter, or without any dictionary, is ``und`` with score 0, not
    accepted. Ids may be null or repeat; texts of any length are read whole; columns not named are
    ignored, and kept ones that have the name of a result give way to it; an empty table gives none.
    """
    model = Classifier(dictionaries, margins, level)
    _text.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *model.column(batch.column(0))], names=[*batch.schema.names[1:], "lang_pred", "score", "accepted"])

    keep = tuple(c for c in dict.fromkeys(keep) if c not in ("doc_id", "lang_pred", "score", "accepted"))
    source = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("doc_id"), *[F.col(f"`{c}`") for c in keep])
    schema = source.drop("__text").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return source.mapInArrow(_text.tidy(task), schema)


def keep_accepted(docs: DataFrame, dictionaries: dict[str, bytes], margins: tuple[tuple[int, float], ...] = MARGINS, level: int = 6, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted (see :func:`identify`).

    Each row is decided by its own text, whatever its id; columns may have any names. Null texts go.
    """
    model = Classifier(dictionaries, margins, level)
    _text.small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(model.column(batch.column(at).cast(pa.string()))[2])

    return docs.mapInArrow(_text.tidy(task), docs.schema)
