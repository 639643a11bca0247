"""Retrieval queries: benchmark texts as questions, documents and embeddings as the knowledge base."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from convolake.functions import fixed
from convolake.functions.text import SPACE_RE2, keywords, text_hash, token_estimate, vector_terms
from convolake.functions.vectors import cosine, dot, norm, term_counts, with_hashed_vector
from convolake.operators import retrieve as R
from convolake.plans.registry import query
from convolake.session import spread

_WORD = f"a-zA-Z0-9_{fixed.TURKISH_LETTERS}"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def keywords_sql(text: str) -> str:
    return (
        f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[{SPACE_RE2}]+'), "
        f"lambda w: length(w) > 2 AND w NOT IN ({_quoted(fixed.KEYWORD_STOPWORDS)})), "
        f"lambda w: regexp_replace(w, '[^{_WORD}]', '', 'g'))"
    )


def terms_sql(text: str) -> str:
    stop = _quoted(fixed.VECTOR_STOPWORDS_TR + fixed.VECTOR_STOPWORDS_EN)
    return (
        f"list_filter(string_split(regexp_replace(lower({text}), '[^{_WORD}]+', ' ', 'g'), ' '), "
        f"lambda w: length(w) > 2 AND w NOT IN ({stop}))"
    )


def hash_sql(term: str) -> str:
    h = (
        f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({term}, ''), "
        "lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"
    )
    return f"abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)"


def vectors_sql(name: str, table: str, key: str) -> str:
    """CTEs ending in ``{name}(key, dim, w)``: the non-zero dimensions of the unit vector of every text."""
    return f"""
{name}_t AS (SELECT {key} AS key, unnest({terms_sql('text')}) AS term,
                    generate_subscripts({terms_sql('text')}, 1) AS pos FROM {table}),
{name}_f AS (SELECT key, term, count(*) AS tf, min(pos) AS pos,
                    CASE WHEN regexp_matches(term, '^[1-9][0-9]{{2,9}}$') AND length(term) <= 10
                          AND CAST(regexp_extract(term, '^[0-9]{{1,10}}$') AS VARCHAR) <> ''
                          AND TRY_CAST(term AS BIGINT) < 4294967295 THEN TRY_CAST(term AS BIGINT) END AS num
             FROM {name}_t GROUP BY key, term),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY num IS NULL, num, pos) AS rn FROM {name}_f),
{name}_h AS (SELECT term, {hash_sql('term')} % {fixed.VECTOR_DIMS} AS dim
             FROM (SELECT DISTINCT term FROM {name}_r WHERE rn <= {fixed.VECTOR_DIMS})),
{name}_d AS (SELECT key, dim, CAST(sum(tf) AS DOUBLE) AS v
             FROM {name}_r JOIN {name}_h USING (term) WHERE rn <= {fixed.VECTOR_DIMS} GROUP BY key, dim),
{name} AS (SELECT key, dim, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS w FROM {name}_d)"""


VECTOR_HITS_SQL = f"""{vectors_sql('qv', 'benchmark', 'item_id')}, {vectors_sql('dv', 'documents', 'doc_id')},
vpairs AS (SELECT q.key AS q_id, d.key AS doc_id, sum(q.w * d.w) AS s FROM qv q JOIN dv d USING (dim) GROUP BY ALL),
vall AS (SELECT b.item_id AS q_id, d.doc_id, round(coalesce(s, 0), 9) AS score
         FROM benchmark b CROSS JOIN documents d LEFT JOIN vpairs p ON p.q_id = b.item_id AND p.doc_id = d.doc_id),
vhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank
                         FROM vall) WHERE rank <= 5)"""
KEYWORD_SQL = f"""kw AS (SELECT item_id AS q_id, unnest({keywords_sql('text')}) AS keyword FROM benchmark),
kwn AS (SELECT q_id, keyword, count(*) AS times FROM kw GROUP BY ALL),
blank AS (SELECT q_id, sum(times) AS blanks FROM kwn WHERE keyword = '' GROUP BY q_id),
ldoc AS (SELECT doc_id, lower(text) AS text, length(text) > 200 AS is_long FROM documents),
found AS (SELECT keyword, doc_id FROM (SELECT DISTINCT keyword FROM kwn WHERE keyword <> '') k
          JOIN ldoc ON contains(ldoc.text, keyword)),
khits AS (SELECT q_id, doc_id, CAST(sum(times) AS BIGINT) AS hits FROM found JOIN kwn USING (keyword) GROUP BY ALL),
kall AS (SELECT b.item_id AS q_id, d.doc_id,
                coalesce(hits, 0) + coalesce(blanks, 0) + CASE WHEN is_long THEN 0.5 ELSE 0 END AS score
         FROM benchmark b CROSS JOIN ldoc d LEFT JOIN khits h ON h.q_id = b.item_id AND h.doc_id = d.doc_id
         LEFT JOIN blank ON blank.q_id = b.item_id),
ktop AS (SELECT * FROM (SELECT q_id, doc_id, CAST(score AS DOUBLE) AS score,
                               row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank
                        FROM kall WHERE score > 0) WHERE rank <= 5)"""
HYBRID_SQL = f"""{VECTOR_HITS_SQL}, {KEYWORD_SQL},
merged AS (SELECT q_id, doc_id, round(max(s), 6) AS final_score FROM (
    SELECT q_id, doc_id, score * 0.7::DOUBLE + (count(*) OVER (PARTITION BY q_id) - rank + 1) * 0.3::DOUBLE AS s
    FROM vhits
    UNION ALL SELECT q_id, doc_id, score * 0.5::DOUBLE FROM ktop) GROUP BY ALL),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY final_score DESC, doc_id) AS rank
                          FROM merged) WHERE rank <= 5)"""
CENTROID_SQL = """cen_d AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS c FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL),
cen AS (SELECT label, list(c ORDER BY dim) AS centroid FROM cen_d GROUP BY label)"""
RELEVANCE_SQL = f"""{CENTROID_SQL},
rel AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 9) AS relevance
        FROM embeddings JOIN cen USING (label))"""


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("q_id"), "text")


def vector_hits(t):
    return R.nearest(
        with_hashed_vector(questions(t), "q_id", "text"),
        with_hashed_vector(spread(t.documents.select("doc_id", "text")), "doc_id", "text"),
    )


def keyword_hits_top(t):
    return R.keyword_top(questions(t), spread(t.documents.select("doc_id", "text")))


def hybrid(t):
    return R.hybrid_merge(vector_hits(t), keyword_hits_top(t))


def relevance(t):
    """Similarity of every vector to the centre of its label, as source rows of a file."""
    e = t.embeddings
    return e.join(R.centroids(e, "label", "embedding"), "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 9).alias("relevance")
    )


@query("u1_hybrid_merge", f"WITH {HYBRID_SQL} SELECT q_id, doc_id, final_score, rank FROM hybrid")
def _(t):
    return hybrid(t)


@query(
    "t6_keywords",
    f"SELECT item_id, word_no, word FROM (SELECT item_id, unnest({keywords_sql('text')}) AS word, "
    f"generate_subscripts({keywords_sql('text')}, 1) - 1 AS word_no FROM benchmark)",
)
def _(t):
    return t.benchmark.select("item_id", F.posexplode(keywords(F.col("text"))).alias("word_no", "word"))


@query(
    "t7_vector_terms",
    f"SELECT doc_id, len({terms_sql('text')}) AS n_terms, array_to_string({terms_sql('text')}, ' ') AS terms "
    "FROM documents",
)
def _(t):
    terms = vector_terms(F.col("text"))
    return t.documents.select("doc_id", F.size(terms).alias("n_terms"), F.array_join(terms, " ").alias("terms"))


@query(
    "t8_text_hash",
    f"SELECT DISTINCT term, {hash_sql('term')} AS hash FROM (SELECT unnest({terms_sql('text')}) AS term FROM benchmark)",
)
def _(t):
    return (
        t.benchmark.select(F.explode(vector_terms(F.col("text"))).alias("term"))
        .distinct()
        .select("term", text_hash(F.col("term")).alias("hash"))
    )


@query(
    "t9_hashed_vector",
    f"WITH {vectors_sql('dv', 'documents', 'doc_id')} SELECT key AS doc_id, dim, round(w, 9) AS weight FROM dv",
)
def _(t):
    return (
        with_hashed_vector(spread(t.documents.select("doc_id", "text")), "doc_id", "text")
        .select("doc_id", F.posexplode("vector").alias("dim", "w"))
        .filter("w <> 0")
        .select("doc_id", "dim", F.round("w", 9).alias("weight"))
    )


@query(
    "a14_term_frequency",
    f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) "
    "GROUP BY ALL",
)
def _(t):
    return term_counts(spread(t.documents.select("doc_id", "text")), "doc_id", "text").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


@query(
    "t24_cosine",
    f"WITH {CENTROID_SQL} SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 8) "
    "AS cosine, round(list_inner_product(CAST(embedding AS DOUBLE[]), centroid), 8) AS dot_product, "
    "round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 8) AS l2_norm "
    "FROM embeddings JOIN cen USING (label)",
)
def _(t):
    e = t.embeddings
    v, c = F.col("embedding"), F.col("centroid")
    return e.join(R.centroids(e, "label", "embedding"), "label").select(
        "vec_id",
        F.round(cosine(v, c), 8).alias("cosine"),
        F.round(dot(v, c), 8).alias("dot_product"),
        F.round(norm(v), 8).alias("l2_norm"),
    )


@query(
    "j17_keyword_hits",
    f"WITH {KEYWORD_SQL} SELECT q_id, doc_id, hits FROM khits",
)
def _(t):
    return R.keyword_hits(questions(t), spread(t.documents.select("doc_id", "text"))).drop("is_long")


@query(
    "j17_keyword_hits_join",
    f"WITH {KEYWORD_SQL} SELECT q_id, doc_id, hits FROM khits",
)
def _(t):
    words = R.question_keywords(questions(t)).filter("keyword <> ''")
    return R.keyword_hits_by_join(words, spread(t.documents.select("doc_id", "text"))).drop("is_long")


@query("k5_keyword_top", f"WITH {KEYWORD_SQL} SELECT q_id, doc_id, score, rank FROM ktop")
def _(t):
    return keyword_hits_top(t)


@query("k4_vector_top", f"WITH {VECTOR_HITS_SQL} SELECT q_id, doc_id, score, rank FROM vhits")
def _(t):
    return vector_hits(t)


@query(
    "j18_nearest_vectors",
    f"""WITH {CENTROID_SQL}
SELECT q_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT label AS q_id, vec_id AS doc_id,
           round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 9) AS score
    FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN cen)) WHERE rank <= 5""",
)
def _(t):
    e = t.embeddings
    centres = R.centroids(e, "label", "embedding").select(
        F.col("label").cast("bigint").alias("q_id"), F.col("centroid").alias("vector")
    )
    return R.nearest(
        centres, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    )


@query(
    "w2_rank_position",
    f"WITH {VECTOR_HITS_SQL} SELECT q_id, doc_id, rank - 1 AS position, count(*) OVER (PARTITION BY q_id) AS n_hits "
    "FROM vhits",
)
def _(t):
    return vector_hits(t).select(
        "q_id",
        "doc_id",
        (F.col("rank") - 1).alias("position"),
        F.count("*").over(Window.partitionBy("q_id")).alias("n_hits"),
    )


@query(
    "w1_citation_limits",
    f"""WITH {RELEVANCE_SQL}
SELECT label AS file_id, vec_id AS source_id, relevance, file_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY relevance DESC, vec_id) AS file_rank
  FROM rel WHERE relevance >= 0.45) WHERE file_rank <= 5 ORDER BY relevance DESC, vec_id LIMIT 30""",
)
def _(t):
    return R.limit_citations(
        relevance(t).select(F.col("label").alias("file_id"), F.col("vec_id").alias("source_id"), "relevance")
    )


@query(
    "k6_nearest_per_file",
    f"""WITH {RELEVANCE_SQL}
SELECT label AS file_id, vec_id AS chunk_id, round(1 - relevance, 6) AS distance, round(relevance, 6) AS relevance
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY relevance DESC, vec_id) AS rn FROM rel)
WHERE rn <= 5 ORDER BY round(1 - relevance, 6), vec_id LIMIT 10""",
)
def _(t):
    kept = R.top_per(relevance(t), ["label"], [F.desc("relevance"), F.asc("vec_id")], 5)
    return (
        kept.select(
            F.col("label").alias("file_id"),
            F.col("vec_id").alias("chunk_id"),
            F.round(1 - F.col("relevance"), 6).alias("distance"),
            F.round("relevance", 6).alias("relevance"),
        )
        .orderBy("distance", "chunk_id")
        .limit(10)
    )


@query(
    "t33_context_text",
    f"""WITH {HYBRID_SQL}
SELECT q_id, string_agg('[' || rank || '] ' || text, E'\\n\\n' ORDER BY rank) AS context,
       CAST(ceil(len(string_split(string_agg('[' || rank || '] ' || text, E'\\n\\n' ORDER BY rank), ' '))
            * CAST(1.3 AS DOUBLE)) AS BIGINT) AS context_tokens,
       string_agg(left(text, 200) || '...', '|' ORDER BY rank) AS snippets
FROM hybrid JOIN documents USING (doc_id) GROUP BY q_id""",
)
def _(t):
    return R.contexts(hybrid(t), t.documents).withColumn("context_tokens", token_estimate(F.col("context")))


@query(
    "a17_retrieval_evaluation",
    f"""WITH {HYBRID_SQL}, n AS (SELECT item_id, count(doc_id) AS sources FROM benchmark
  LEFT JOIN hybrid ON q_id = item_id GROUP BY item_id)
SELECT count(*) AS total, count_if(sources >= 1) AS successful,
       round(100.0 * count_if(sources >= 1) / count(*), 2) AS success_pct, round(avg(sources), 4) AS mean_sources
FROM n""",
)
def _(t):
    counts = (
        questions(t)
        .join(hybrid(t).select("q_id", "doc_id"), "q_id", "left")
        .groupBy("q_id")
        .agg(F.count("doc_id").alias("sources"))
    )
    return counts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("sources") >= 1).alias("successful"),
        F.round(100.0 * F.count_if(F.col("sources") >= 1) / F.count("*"), 2).alias("success_pct"),
        F.round(F.avg("sources"), 4).alias("mean_sources"),
    )
