"""The registered queries of this subpackage: one for each operator, over whole tables, with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import ORDER_HASH_SQL, cut, documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SHARD_BYTES = 256 << 10
RANKS = "byte_bpe_multi_50k.tiktoken"

# DuckDB's pattern for a word.
WORD_SQL = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query(
    "op3_sharding",
    f"""
WITH sized AS (SELECT doc_id, {ORDER_HASH_SQL} AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents),
tree AS (
  SELECT doc_id, h, bytes, bits, h >> (60 - bits) AS bucket,
         sum(bytes) OVER (PARTITION BY bits, h >> (60 - bits)) AS shard_bytes
  FROM sized, (SELECT CAST(range AS INTEGER) AS bits FROM range(0, 61)) WHERE bytes <= {SHARD_BYTES}),
leaf AS (SELECT doc_id, h, bytes, min(bits) AS bits FROM tree WHERE shard_bytes <= {SHARD_BYTES} GROUP BY ALL)
SELECT t.doc_id, t.bytes, t.bits || ':' || t.bucket AS shard, CAST(t.bits AS INTEGER) AS bits,
       CAST(t.shard_bytes AS BIGINT) AS shard_bytes
FROM tree t JOIN leaf l ON t.doc_id = l.doc_id AND t.h = l.h AND t.bits = l.bits
UNION ALL
SELECT doc_id, bytes, h || ':big', 60, bytes FROM sized WHERE bytes > {SHARD_BYTES}""",
)
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.sharding import plan_shards

    return plan_shards(documents(spark, sf_dir), SHARD_BYTES).select("doc_id", "bytes", "shard", "bits", "shard_bytes")


@query("op4_media_columns")
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.media import digests

    return digests(documents(spark, sf_dir))


@query(
    "op5_curriculum_mix",
    f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) AS BIGINT) AS size,
         {ORDER_HASH_SQL} AS k FROM documents),
src AS (
  SELECT source, source_size, rank, 1.0 + rank % 3 AS weight, CAST(source_size * 3 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
        FROM sized GROUP BY source)),
filled AS (
  SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= weight * (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped FROM src),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    CAST(weight AS DOUBLE) * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))
    / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) END AS target FROM filled),
ordered AS (
  SELECT s.*, source_size, target, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 3) AS whole,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN whole < 3
            AND before + CAST(size AS DOUBLE) / 2 <= target - whole * source_size THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM ordered""",
)
def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.mixing import plan_mix

    mix = plan_mix(documents(spark, sf_dir))
    mix = mix.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))
    first = F.element_at(F.concat("positions", F.array(F.lit(None).cast("double"))), 1)
    taken = (F.col("size") * F.size("positions")).alias("taken")
    return mix.orderBy(first, "key").select("doc_id", "size", "source_size", "target", taken)


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.bpe import digests

    return digests(documents(spark, sf_dir), public_tokenizers.path(RANKS))


@query("op6_token_packing")
def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.packing import pack

    rows = pack(documents(spark, sf_dir), public_tokenizers.path(RANKS))
    ids, positions = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256")
    return rows.select("group", "window", "row", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", ids, positions)


def classified(docs: DataFrame, held_out, score) -> DataFrame:
    out = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm import toxicity
    from episodica.llm.labelled import fold

    docs, part = documents(spark, sf_dir), fold(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), part != 0)
    return classified(docs, F.coalesce(part == 0, F.lit(False)), toxicity.score(F.col("text"), model))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm import quality
    from episodica.llm.labelled import fold

    docs, part = documents(spark, sf_dir), fold(F.col("doc_id"), 3)
    model = quality.train(docs, table(spark, sf_dir, "labels"), part != 1)
    return classified(docs, F.coalesce(part == 1, F.lit(False)), quality.score(F.col("text"), model))


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm import rules

    stats = cut(rules.statistics(documents(spark, sf_dir)), "statistics")
    learned = rules.learn(rules.labelled_statistics(stats, table(spark, sf_dir, "labels")))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rules.judged(stats, learned).select("doc_id", *columns)


@query("op8_private_data")
def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.pii import digest

    return digest(documents(spark, sf_dir))


@query("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.jaccard import clusters

    return clusters(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.align import digests

    return digests(documents(spark, sf_dir), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))




@query("op13_license_scan")
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm.licenses import digests

    return digests(documents(spark, sf_dir))


@query(
    "op11_prefix_trie",
    """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(said)) AS pos, md5(said) AS t, bytes
  FROM (SELECT conv_id, turn, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
               strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(string_split(CAST(c AS VARCHAR), ''), lambda crc, s:
           list_reduce(range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, ord(s))),
           4294967295), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, 0 AS own, t.pos, t.t, t.bytes FROM convs v JOIN turns t ON t.c = v.base AND t.pos <= v.h
  UNION ALL SELECT v.c, 1, t.pos, t.t, t.bytes FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
placed AS (SELECT c, row_number() OVER w AS depth, string_agg(t, ',') OVER w AS p, bytes FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
path AS (
  SELECT c, 0 AS depth, '' AS p, 0 AS bytes, NOT EXISTS (SELECT 1 FROM placed r WHERE r.c = convs.c) AS ends FROM convs
  UNION ALL SELECT c, depth, md5(p), bytes, depth = max(depth) OVER (PARTITION BY c) FROM placed),
linked AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY depth) AS q FROM path),
nodes AS (
  SELECT depth, p, any_value(q) AS q, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY depth, p),
sized AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, o.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN (SELECT q, depth - 1 AS depth, count(*) AS n_children FROM nodes GROUP BY ALL) k ON k.q = n.p AND k.depth = n.depth
  LEFT JOIN nodes o ON o.p = n.q AND o.depth = n.depth - 1),
below AS (
  SELECT a.p, a.depth, sum(CASE WHEN s.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((s.n_convs - 1) * s.bytes) AS saved_tokens
  FROM sized s JOIN linked b ON b.c = s.conv_id AND b.depth <= s.depth JOIN nodes a ON a.p = b.p AND a.depth = b.depth GROUP BY a.p, a.depth)
SELECT conv_id, CAST(s.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM sized s JOIN below USING (p, depth)""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from episodica.llm import trie

    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    return trie.trie(*trie.rebuilt(table(spark, sf_dir, "conversations"), conv - conv % 5, heads)).drop("p")
