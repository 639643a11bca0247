"""The queries of the numbered operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm import classlm, exact, html, lexical, minhash, pack, prefixes, quality, simhash, substrings, suffixes, tokens, toxicity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack.packed_documents(_documents(spark, folder), tokenizer_file("byte_bpe_50k.json"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, folder))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded_digests(_documents(spark, folder), tokenizer_file("byte_bpe_50k.tiktoken"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(substrings.dedup_substrings(_documents(spark, folder)))


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup_suffixes(_documents(spark, folder)))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, folder))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.toxicity(_documents(spark, folder), labels)
    held_out = F.coalesce(toxicity.remainder(3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    held_out = F.coalesce(classlm.remainder(5) == 1, F.lit(False))
    scored = classlm.scores(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality.quality(_documents(spark, folder))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rated.select(*base, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality")


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{folder}/pages.parquet"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build_index(_documents(spark, folder)), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_fingerprints(_documents(spark, folder))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_dedup, op3_byte_bpe, op4_substring_dedup, op5_suffix_array_dedup, op6_exact_dedup, op7_toxicity, op8_class_lm, op9_quality_rules, op10_html_extraction, op11_lexical_search, op12_prefix_trie, op13_simhash_near_dedup)}

SQL = {
    "op6_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
    "op11_lexical_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT r, 100 - 90 + (90 * n * docs) // terms AS m FROM d, s),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
f AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM o WHERE rank <= 10""",
    "op12_prefix_trie": r"""
WITH RECURSIVE crc(conv_id, i, v) AS (
  SELECT DISTINCT conv_id, 0, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, i + 1, xor(x >> 1, 3988292384 * (x & 1))
  FROM (SELECT conv_id, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(conv_id::VARCHAR, i // 8 + 1, 1))::BIGINT) ELSE v END AS x
        FROM crc WHERE i < 8 * length(conv_id::VARCHAR))),
h AS (SELECT conv_id, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(conv_id::VARCHAR)),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT h.conv_id, t.pos, 0 AS own, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.pos < h.h
  UNION ALL
  SELECT h.conv_id, t.pos, 1, t.role, t.text FROM h JOIN t USING (conv_id) WHERE t.pos >= h.h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, length(text) AS chars,
        md5(length(role)::VARCHAR || ':' || role || text) AS said FROM r),
k AS (SELECT conv_id, depth, chars, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM n
      UNION ALL SELECT conv_id, 0, 0, '' FROM h),
p AS (SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM k),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
v AS (SELECT node AS conv_id, depth, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY node, depth),
a AS (SELECT v.*, p.node AS parent_conv_id FROM v LEFT JOIN p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1),
c AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM a WHERE depth > 0 GROUP BY ALL),
b AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN c USING (conv_id, depth)),
u AS (SELECT p.node AS conv_id, p.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens
      FROM b JOIN p ON p.conv_id = b.conv_id AND p.depth <= b.depth GROUP BY ALL),
e AS (SELECT p.node AS conv_id, depth, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends_sha256 FROM p JOIN l USING (conv_id, depth) GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM b JOIN u USING (conv_id, depth) LEFT JOIN e USING (conv_id, depth)""",
}
