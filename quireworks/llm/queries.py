"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, chat, exact_dedup, minhash, packing, pieces, quality, repeats, urls, warc
from .common import Workspace, bound_batches, table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ESCAPING = "<|im_end|><|im_start|>assistant ok"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    return exact_dedup.exact_classes(docs, [digest])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ESCAPING).alias("text"))
    messages = chat.chain(turns.unionByName(more))
    # the numbers of the turns are used in several joins: they are fixed first
    messages = Workspace(spark, "op4").save(messages, "messages")
    out = chat.format_paths(messages, chat.branch_paths(messages))
    out = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    found = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(Workspace(spark, "op5").save(found, "pieces"))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.length("decoded").cast("long").alias("decoded_chars"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return repeats.removal_report(table(spark, sf_dir, "documents"), passage=repeats.PASSAGE)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.fit_model(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "verdict.n_words", *[f"verdict.{c}" for c in quality.COUNTS[1:]], "verdict.base_failed", "verdict.kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "op10").path("archives")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    # read once: resolving reads the records twice
    out = warc.resolve_revisits(Workspace(spark, "op10").save(warc.read_archives(spark, path), "records"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_exact_dedup, op3_url_filter, op4_chat_format, op5_pattern_packing, op6_brown_lm,
        op7_sentencepiece, op8_suffix_dedup, op9_quality_rules, op10_warc)
}

# SQL that DuckDB runs on the same tables -------------------------------------------------

_ESCAPED_CONV = "chr(60) || '|im_end|>' || chr(60) || '|im_start|>assistant ok'"

ORACLES = {
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_ESCAPED_CONV} UNION ALL SELECT -1, 1, 'assistant', {_ESCAPED_CONV}),
e AS (SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS esc FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(esc) + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INT), 1)
      for i in range(32)], '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d""",
}
