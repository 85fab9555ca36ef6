"""WARC 1.1 archives: writing captures as transactions, and assembling them again.

A capture is three records: request, response (or revisit) and metadata. Request and metadata name
the response by WARC-Concurrent-To. Archives are written by Spark's own text writer (gzip), so its
commit protocol and any store that Spark knows apply; they are read as whole files, each by one task.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from ._spread import join_spread

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records' date where the capture has none.
DATE = "2000-01-01T00:00:00Z"
#: Captures in one file at most, and bytes of their payloads. A file is read by one task, as one value.
FILE_CAPTURES, FILE_BYTES = 4000, 1 << 28
#: Payloads up to each of these sizes are written to files of their own, and larger ones too.
CLASSES = (1 << 16, 1 << 22)
#: A response of a few bytes more than its payload: status line and headers.
_READ = 1 << 20


def base32(hexed: Column) -> Column:
    """40 hex digits as 32 upper-case base32 letters."""
    out = []
    for k in range(8):  # five hex digits are four letters
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(kind: str, record_id: Column, headers: list[Column], block: Column) -> Column:
    """One record without the line feed at its very end, which the writer adds."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\n"), *headers]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))], F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes each row as a transaction of three records under ``path``.

    Rows of equal payloads of at least ``min_bytes`` bytes are written once: the one of greatest id
    (all that have it, if the id repeats) as response, the others as revisits that refer to it. A null
    body is an empty payload and a null url an empty target; a null id is less than all others.
    Columns not named are ignored; an empty table writes no records. Files hold FILE_CAPTURES captures and
    FILE_BYTES of payloads at most (or one capture), pages of like sizes together.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("url", F.regexp_replace("url", r"[\x00-\x20\x7f]", "")).withColumn("digest", F.sha1("body")).withColumn("bytes", F.octet_length("body").cast("long"))
    page = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    size_class = F.lit(0)
    for k, limit in enumerate(CLASSES):
        size_class = F.when(F.col("bytes") > limit, k + 1).otherwise(size_class)
    sizes = rows.groupBy("id", "digest", size_class.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))
    classes = sizes.groupBy("class").agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).collect()
    if any(c["n"] > 1 for c in classes):
        # Rows that repeat an id and payload need numbers, and these must stay as they are: a written table.
        rows = Scratch(pages.sparkSession, "warc-rows").put(rows.withColumn("row", F.concat_ws(":", page, "digest", F.monotonically_increasing_id().cast("string"))), "rows")
    else:
        rows = rows.withColumn("row", F.concat_ws(":", page, "digest"))
    newest = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max(F.struct(F.coalesce("id", F.lit(-(2**63))).alias("k"), "row")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = join_spread(rows, newest, ["digest", "bytes"], "n", "row")
    revisit = F.col("top").isNotNull() & (F.coalesce("id", F.lit(-(2**63))) < F.col("top.k"))

    key = F.col("row")
    response = _urn("response", key)
    target = F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n"))
    own = F.concat(F.lit("X-Capture-Key: "), page, F.lit("\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest")), F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    kind = F.lit("Content-Type: application/http; msgtype=response\r\n")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response, F.lit("\r\n"))
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn("response", F.col("top.row")), F.lit("\r\n"))
    request = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n"))
    records = [
        _record("request", _urn("request", key), [target, F.lit("Content-Type: application/http; msgtype=request\r\n"), concurrent], request),
        F.when(revisit, _record("revisit", response, [target, own, digest, kind, refers], http)).otherwise(_record("response", response, [target, own, digest, kind], F.concat(http, F.col("body")))),
        _record("metadata", _urn("metadata", key), [target, F.lit("Content-Type: application/warc-fields\r\n"), concurrent], F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))),
    ]
    lines = rows.select(size_class.alias("class"), F.explode(F.array(*records)).alias("value"))
    for c in classes or [{"class": 0, "bytes": 0}]:
        captures = max(1, min(FILE_CAPTURES, FILE_BYTES // (c["bytes"] + 1)))
        part = lines.where(F.col("class") == c["class"]).select("value") if len(classes) > 1 else lines.select("value")
        part.write.option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(f"{path}/size-{c['class']}")


def _lines(head: bytes) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, gzipped or not.

    Gzip members follow one another; whole files may be one member. Blocks are taken by
    Content-Length only. A truncated last record is left out.
    """
    buffer, rest = bytearray(), memoryview(data)
    unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
    at = 0
    while True:
        end = buffer.find(b"\r\n\r\n", at)
        need = None
        if end >= 0:
            headers = _lines(bytes(buffer[at:end]))
            need = end + 4 + int(headers.get("content-length", "0"))
        if need is None or len(buffer) < need:
            if at:
                del buffer[:at]
                at = 0
            if not len(rest) and not (unzip and unzip.unconsumed_tail):
                return
            if unzip is None:
                buffer += rest[:_READ]
                rest = rest[_READ:]
                continue
            part = unzip.unconsumed_tail or bytes(rest[:_READ])
            if not unzip.unconsumed_tail:
                rest = rest[_READ:]
            buffer += unzip.decompress(part, _READ)
            if unzip.eof:
                rest = memoryview(unzip.unused_data + bytes(rest)) if unzip.unused_data else rest
                if len(rest):
                    unzip = zlib.decompressobj(31)
            continue
        yield headers, bytes(buffer[end + 4 : need])
        at = need
        while buffer[at : at + 2] == b"\r\n":
            at += 2


RECORDS = "kind string, record_id string, concurrent_to string, refers_to string, target string, capture_key string, digest string, n_bytes long, fields string, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per WARC record under ``path``; a payload is what follows a response's HTTP head.

    ``digest`` is computed from the payload where the record holds it, and otherwise what the header
    says. Without ``payloads`` the column is null, and only lengths and digests leave the reader.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows: list[tuple] = []
                held = 0
                for h, block in parse(batch.column(0)[k].as_py()):
                    kind, body, n, fields = h.get("warc-type"), None, None, None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        body = block[block.find(b"\r\n\r\n") + 4 :]
                        n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("x-capture-key"), digest, n, fields, body if payloads else None))
                    held += len(block) if payloads else 200
                    if held > 4_000_000:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(task, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_key, target, response, request, metadata, original``.

    Requests and metadata are joined to the response or revisit that they name as concurrent; a
    revisit's ``original`` is the response it refers to. Parts that an archive lacks are null.
    Records repeated under one id count once. ``records`` is read several times, so it should be a written table.
    """
    part = lambda kind, name: records.where(F.col("kind") == kind).dropDuplicates(["record_id"]).select(F.col("concurrent_to").alias("id"), F.struct("record_id", "fields").alias(name))
    once = lambda kind, name: part(kind, name).groupBy("id").agg(F.min(name).alias(name))
    main = records.where("kind in ('response', 'revisit')").dropDuplicates(["record_id"])
    main = main.select(F.col("record_id").alias("id"), "capture_key", "target", "refers_to", F.struct("kind", "record_id", "digest", "n_bytes", "payload").alias("response"))
    whole = main.join(once("request", "request"), "id", "left").join(once("metadata", "metadata"), "id", "left")
    response = F.col("response")
    wanted = whole.where("refers_to is not null").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    origin = records.where("kind = 'response'").dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to"), F.struct("capture_key", "record_id", "digest", "n_bytes").alias("original"))
    # Only captures that refer to another are joined; many can refer to one.
    columns = ["capture_key", "target", "response", "request", "metadata"]
    revisits = whole.where("refers_to is not null").withColumn("own", response["record_id"])
    met = join_spread(revisits, wanted.join(origin, "refers_to"), ["refers_to"], "n", "own").select(*columns, "original")
    alone = whole.where("refers_to is null").select(*columns, F.lit(None).cast(met.schema["original"].dataType).alias("original"))
    return alone.unionByName(met)


def round_trip(spark: SparkSession, pages: DataFrame, path: str, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Writes ``pages`` under ``path`` and returns what :func:`assemble` reads there."""
    write_archives(pages, path, min_bytes)
    return assemble(Scratch(spark, "warc-records").put(read_records(spark, path, payloads), "records"))
