"""The queries of this subpackage: thin digests of its operators' results over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.token_count import count_tokens, read_pieces

    vocab = read_pieces(vocabulary("piece_bpe_32k.model"))
    return count_tokens(table(spark, sf_dir, "documents"), vocab).select("doc_id", "n_chars", "n_tokens", "best_score")


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.html_extract import extract

    out = extract(table(spark, sf_dir, "pages"), keep_article=True)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_pages")


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.near_dedup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents
), w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm._spark import shared_dir
    from basketry.llm.sharding import shard

    maps = f"{shared_dir(spark)}/slot-maps-by-text/{hashlib.sha256(sf_dir.encode()).hexdigest()}"
    out = shard(table(spark, sf_dir, "documents"), shards=40, maps=maps)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.toxicity import fit, held_out, score

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, labels.where(~held_out("doc_id")), label_column="toxic")
    out = score(documents, model)
    return out.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "sentences",
        "worst_start",
        "worst_end",
    )


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


ORACLE["op9_chat_formatting"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, content) - 1 AS position FROM t
), s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
r AS (
  SELECT n.conv_id, s.perspective, n.turn, n.position, n.speaker, n.speaker = s.perspective AS trained,
    CASE WHEN n.speaker = s.perspective THEN '<|assistant|>' ELSE '<|user|>' || n.speaker || ': ' END AS head, n.content || '<|end|>' || chr(10) AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS e FROM r
)
SELECT conv_id, perspective, turn, CAST(position AS BIGINT) AS position, speaker, trained, head || body AS rendered,
  CAST(e - length(head) - length(body) AS BIGINT) AS "start",
  CAST(CASE WHEN trained THEN e - length(body) END AS BIGINT) AS mask_start, CAST(CASE WHEN trained THEN e - 1 END AS BIGINT) AS mask_end,
  CAST(e AS BIGINT) AS "end"
FROM p
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.warc import read_archives, write_archives

    archive = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset")


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.spelling import typing_errors, variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents"), change=typing_errors(31)))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns as a faulty crawl would have them, by crc32 of `conv_id:turn` modulo 20: 0 is lost, 1 empty, 2 without `.!?`, 3 there twice, 4 the user's. Nulls are a space."""

    def text(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "utf-8")), F.lit(20))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("copy"),
    )
    return rows.drop("copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.repair import repair

    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), ids=conversations.select("conv_id").distinct()).conversations


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.line_dedup import line_duplicates

    out = line_duplicates(table(spark, sf_dir, "documents"), least_length=20, least_documents=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op11_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM d),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.stays AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
