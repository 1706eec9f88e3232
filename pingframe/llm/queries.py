"""One registered query for each operator of the subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, lm, mixing, packing, periodic, pii, sharding, simhash, toxicity, variants, warc
from .common import WORD, crc32_of_id, shared_folder, stored, table, utf8, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _spans(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["from"].cast("string"), s["to"].cast("string"))), ",")


@query
def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply; masks as from:to lists."""
    out = chat.format_preferences(chat.swapped_replies(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "n_prompt", "prompt", "chosen_completion", _spans("chosen_mask").alias("chosen_mask"),
                      "rejected_completion", _spans("rejected_mask").alias("rejected_mask"))


ORACLES["op1_preference_pairs"] = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, role, text,
         '<|' || role || chr(124) || '>' || chr(10) || text || '<|end|>' || chr(10) AS r
  FROM conversations),
l AS (SELECT conv_id, max(n) AS total, max(CASE WHEN role = 'assistant' THEN n END) AS at FROM t GROUP BY conv_id),
reply AS (SELECT t.conv_id, t.role, t.text, t.r FROM t JOIN l ON t.conv_id = l.conv_id AND t.n = l.at),
rej AS (
  SELECT t.conv_id, t.n, t.role, t.text, t.r FROM t JOIN l ON t.conv_id = l.conv_id WHERE t.n < l.at
  UNION ALL
  SELECT l.conv_id, l.at, o.role, o.text, o.r FROM l JOIN reply o ON o.conv_id <> l.conv_id AND o.conv_id // 2 = l.conv_id // 2 WHERE l.at IS NOT NULL),
p AS (
  SELECT l.conv_id, l.total, coalesce(min(CASE WHEN x.conv_id IS NULL OR x.role <> t.role OR x.text <> t.text THEN t.n END), l.total + 1) - 1 AS k
  FROM l JOIN t ON t.conv_id = l.conv_id LEFT JOIN rej x ON x.conv_id = t.conv_id AND x.n = t.n GROUP BY l.conv_id, l.total),
sides AS (
  SELECT 'c' AS side, t.conv_id, t.n, t.role, t.r, p.k FROM t JOIN p ON p.conv_id = t.conv_id
  UNION ALL SELECT 'r', x.conv_id, x.n, x.role, x.r, p.k FROM rej x JOIN p ON p.conv_id = x.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(r)) OVER (PARTITION BY side, conv_id, n <= k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sides)
SELECT p.conv_id, CAST(p.k AS INTEGER) AS n_prompt,
  coalesce(string_agg(CASE WHEN side = 'c' AND n <= s.k THEN r END, '' ORDER BY n), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 'c' AND n > s.k THEN r END, '' ORDER BY n), '') AS chosen_completion,
  coalesce(string_agg(CASE WHEN side = 'c' AND n > s.k AND role = 'assistant' THEN (start + 14) || ':' || (start + length(r) - 1) END, ',' ORDER BY n), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN side = 'r' AND n > s.k THEN r END, '' ORDER BY n), '') AS rejected_completion,
  coalesce(string_agg(CASE WHEN side = 'r' AND n > s.k AND role = 'assistant' THEN (start + 14) || ':' || (start + length(r) - 1) END, ',' ORDER BY n), '') AS rejected_mask
FROM p LEFT JOIN placed s ON s.conv_id = p.conv_id GROUP BY p.conv_id, p.k
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_matches(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return found.select("doc_id", F.inline("matches"))


@query
def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", sharding.record_bytes(F.col("text")).alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32")), "shard-rows")
    out = sharding.balanced_shards(docs, 40, F.col("size"), tie=F.col("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("h")), "mix-rows")
    out = mixing.mix(docs, size=F.col("words"), tie=F.col("h"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")


@query
def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, pii.train(docs)).drop("text")
    return found.select("doc_id", "pii.*")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_archives"] = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which repeat their words from some place on, as their ids say."""
    h, words = F.col("h"), F.col("w")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), crc32_of_id(F.col("doc_id")).alias("h"))
    n, g = F.size(words), F.floor(h / 10)
    start, period = F.col("a"), F.col("p")
    looped = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < start, i).otherwise(start + (i - start) % period).cast("int"))), " ")
    docs = (docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
            .withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - start) / (3 + g % 8)))
            .select("doc_id", F.when(n > 0, looped).otherwise(F.col("text")).alias("text")))
    found = periodic.with_runs(docs).withColumn("top", periodic.longest("runs"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.p").alias("period"),
                        F.floor(-1000 * F.col("top.l") / F.col("top.p")).alias("exponent_milli"),
                        F.sha2(F.encode(periodic.written_runs("runs"), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one in 97 of a document's words with a letter dropped, and the forms they vary."""
    found = variants.words(table(spark, sf_dir, "documents")).where(F.length("word") >= variants.LENGTH)
    return variants.with_forms(variants.counted(variants.dropped_letters(found)))


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
