"""The operators as registered queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import alignment, decontamination, fill_middle, fingerprints, inner_products, kd_shards, line_dedup, minhash, packing, quality, secrets, style_tree, toxicity
from pricetide.llm.common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op3_secret_ownership")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """An owner is a source; its repositories are its languages."""
    docs = table(spark, folder, "documents")
    found = secrets.find_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    count = lambda kind: F.size(F.filter("base", lambda c: c.kind == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("every")).alias("spans"), "n_live", "n_copied")


@query("op6_kd_tree_shards")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    cut = kd_shards.document_shards(table(spark, folder, "documents"), leaves=8)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


TOP_K_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT vec_id, min(v) AS v FROM fine GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20"""


@query("op7_inner_product_top_k", TOP_K_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    vectors = inner_products.integer_vectors(table(spark, folder, "embeddings"))
    return inner_products.top_k(vectors, vectors.filter("id % 20 = 0"), 20)


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, pos - 1 AS pos, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM (SELECT DISTINCT doc_id, text FROM documents))
), counted AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) AS upto FROM (
    SELECT *, len(string_split_regex(bare, '[\t\x0B\f\r ]+')) AS words FROM lines WHERE bare <> '')
), runs AS (
  SELECT a.doc_id, a.text, a.pos AS first, b.pos AS last, string_agg(c.bare, chr(10) ORDER BY c.pos) AS content
  FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND a.text = b.text AND a.pos <= b.pos
  JOIN counted c ON a.doc_id = c.doc_id AND a.text = c.text AND c.pos BETWEEN a.pos AND b.pos
  WHERE b.upto - a.upto + a.words >= 50 AND (b.upto - b.words - a.upto + a.words < 50 OR b.upto - a.upto < 50)
  GROUP BY ALL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS n FROM runs) WHERE n > 1
), kept AS (
  SELECT d.doc_id, d.text, string_agg(d.line, chr(10) ORDER BY d.pos) FILTER (NOT d.gone) AS left_text, count(*) FILTER (d.gone) AS n_removed
  FROM (
    SELECT l.doc_id, l.text, l.line, l.pos,
      EXISTS (SELECT 1 FROM later r WHERE r.doc_id = l.doc_id AND r.text = l.text AND l.pos BETWEEN r.first AND r.last) AS gone
    FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM (SELECT DISTINCT doc_id, text FROM documents)) l
  ) d GROUP BY d.doc_id, d.text
)
SELECT doc_id, coalesce(left_text, '') AS text, n_removed FROM kept"""


@query("op10_line_winnowing", LINE_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed="n_removed")


@query("op1_minhash_bayes")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def tokenizer_files() -> tuple[str, str, str]:
    path = public_tokenizers.path
    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op5_grouped_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), *tokenizer_files())


@query("op11_arrow_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, folder, "documents"), *tokenizer_files(), public_tokenizers.path("piece_bpe_32k.model"))


MIDDLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS c1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS c2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), cut AS (
  SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""


@query("op12_exception_index_middle", MIDDLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"), *fill_middle.drawn_cuts(F.col("doc_id")))
    made = fill_middle.restore(made)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


@query("op13_invertible_sketch")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    versions = fingerprints.edited_versions(table(spark, folder, "documents")).withColumn("edited_sha256", F.sha2("edited", 256))
    found = fingerprints.compare_versions(versions, ["text", "edited", "next_text"])
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.col("text_print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        F.col("edited_near").alias("near_edited"), F.col("next_text_near").alias("near_next"), F.col("edited_gained").alias("n_gained"),
        F.col("edited_lost").alias("n_lost"))


@query("op2_additive_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_recurrent_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_qgram_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_site_style_tree")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return style_tree.extract(table(spark, folder, "pages"))
