"""The queries of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import decontaminate, jaccard_join, language_id, packing, secret_scan, sharding, substring_dedup, token_counts, topk, warc

#: Shards of op10.
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Where the tokenizer files lie, if not at the installed package's place.
VOCABULARY_DIR: str | None = None


def vocabulary(name: str) -> str:
    if VOCABULARY_DIR:
        return f"{VOCABULARY_DIR}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 20, with_text=False).drop("removed")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(spark, table(spark, sf_dir, "pages"), Scratch(spark, "warc").path)
    revisit = F.col("response.kind") == "revisit"
    return captures.select(
        F.expr("try_cast(capture_key as bigint)").alias("page_id"),
        F.when(revisit, F.col("original.n_bytes")).otherwise(F.col("response.n_bytes")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(revisit, F.expr("try_cast(original.capture_key as bigint)")).alias("refers_to"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(spark, table(spark, sf_dir, "documents")).drop("candidate")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(spark, table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    dictionaries, margins = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs, dictionaries, margins, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(spark, table(spark, sf_dir, "documents").select("doc_id", "source"), SHARDS)


QUERIES = {f.__name__: f for f in (op1_packing, op2_topk, op3_substring_dedup, op4_decontamination, op5_warc, op6_secret_scan, op7_jaccard_join, op8_language_id, op9_token_counts, op10_sharding)}

_WORDS = r"""w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL))"""
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> {shift}) & 31) + 1, 1)"
_BASE32 = "array_to_string(list_transform(range(8), lambda k: " + " || ".join(_LETTER.format(shift=s) for s in (15, 10, 5, 0)) + "), '')"


def _shard_sql() -> str:
    """The table of slots as text, a letter pair for each slot's shard."""
    table = sharding.fill_table(SHARDS)
    text = "".join(f"{k:02d}" for k in table)
    slot = "(('0x' || substr(md5(coalesce('v' || doc_id::VARCHAR, 'n')), 1, 15))::BIGINT % " + str(len(table)) + ")"
    return f"SELECT doc_id, source, slot::INTEGER AS slot, 'shard-0' || substr('{text}', (2 * slot + 1)::BIGINT, 2) AS shard FROM (SELECT doc_id, source, {slot} AS slot FROM documents)"


ORACLES: dict[str, str] = {
    "op2_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_substring_dedup": f"""WITH {_WORDS.format(text="text")},
        g AS (SELECT doc_id, pos, word, count(*) OVER n AS n, string_agg(word, ' ') OVER n AS g FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 AS again FROM g WHERE n = 20),
        c AS (SELECT w.doc_id, w.pos, w.word, coalesce(max(again::INTEGER) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos),
        d AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept FROM c GROUP BY 1)
        SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM documents LEFT JOIN d USING (doc_id)""",
    "op5_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM (SELECT *, sha1(body) AS h FROM p)""",
    "op7_jaccard_join": f"""WITH RECURSIVE {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
        g AS (SELECT doc_id, pos, count(*) OVER n AS n, string_agg(word, ' ') OVER n AS g FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        e AS (SELECT DISTINCT doc_id, g FROM g WHERE n = 5 OR pos = 1),
        s AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
        SELECT documents.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id FROM documents LEFT JOIN s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)""",
    "op10_sharding": _shard_sql(),
}
