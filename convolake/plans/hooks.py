"""Callers' own tokenizers, chunkers and page extractors over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from convolake.functions.content import counted_message_tokens
from convolake.functions.tokenizers import ESTIMATE, arrow_tokenizer, byte_pairs
from convolake.operators import context as C
from convolake.operators import hooks as H
from convolake.plans.registry import ENTRIES, query
from convolake.plans.text import PARTS_SQL, part_rows
from convolake.session import fresh_path, spread

PIECES = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \t\n]"


def piece_counter():
    pattern = re.compile(PIECES)
    return lambda texts: [sum(1 for _ in pattern.finditer(t)) for t in texts]


PIECE_TOKENS = arrow_tokenizer(piece_counter)


def pieces_sql(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{PIECES}')) AS BIGINT)"


def vocabulary():
    """The byte-pair vocabulary of the queries; its place is the caller's to choose."""
    import public_tokenizers

    return byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def message_tokens(t, tokenizer):
    return part_rows(t).select("conv_id", "turn", counted_message_tokens(F.col("role"), F.col("parts"), tokenizer).alias("tokens"))


@query("x2_message_tokens_estimate", ENTRIES["t4_message_tokens"].sql)
def _(t):
    return message_tokens(t, ESTIMATE)


@query(
    "x2_message_tokens_pieces",
    f"""WITH {PARTS_SQL} SELECT conv_id, turn, 3 + {pieces_sql('any_value(role)')} + CAST(sum(CASE WHEN x = '' THEN CASE type WHEN 'tool_call' THEN 1 ELSE 0 END
        WHEN type = 'text' THEN {pieces_sql('x')} WHEN type = 'tool_call' THEN 1 + {pieces_sql('x')} + {pieces_sql("replace(x, 'a', 'b')")}
        ELSE 0 END) AS BIGINT) AS tokens FROM parts GROUP BY conv_id, turn""",
)
def _(t):
    return message_tokens(t, PIECE_TOKENS)


@query("x2_message_tokens_bpe")
def _(t):
    return message_tokens(t, vocabulary())


def context_of(t, tokenizer, limit):
    counted = t.messages().select("conv_id", "msg", tokenizer.count(F.col("text")).alias("tokens"))
    return C.within_limit(counted, limit).select("conv_id", "msg", "tokens", "in_context", "remaining")


@query(
    "x2_context_pieces",
    f"""WITH m AS (SELECT conv_id, turn AS msg, {pieces_sql('text')} AS tokens FROM conversations),
        s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY msg DESC) AS suffix FROM m),
        f AS (SELECT *, 3 + suffix <= 300 AND 3 + suffix - tokens < 300 AS in_context FROM s)
        SELECT conv_id, msg, tokens, in_context, 297 - CAST(sum(CASE WHEN in_context THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS remaining FROM f""",
)
def _(t):
    return context_of(t, PIECE_TOKENS, 300)


@query("x2_context_bpe")
def _(t):
    return context_of(t, vocabulary(), 300)


def chunked(t, tokenizer):
    texts = spread(t.documents.select("doc_id", "text"))
    return H.chunk_rows(texts, "text", H.chunker(tokenizer))


@query("x3_chunk_function", ENTRIES["t5_chunks"].sql)
def _(t):
    return chunked(t, ESTIMATE)


@query("x3_chunk_function_sql", ENTRIES["t5_chunks"].sql)
def _(t):
    H.register_chunker(t.spark, "chunk_text", H.chunker())
    spread(t.documents.select("doc_id", "text")).createOrReplaceTempView("chunk_source")
    return t.spark.sql("SELECT doc_id, chunk_index, content, tokens FROM chunk_source, LATERAL chunk_text(text)")


@query("x3_chunk_function_bpe")
def _(t):
    return chunked(t, vocabulary())


def form_feeds(path: str, content: bytes):
    """Pages of a text file, parted by form feeds."""
    for page in content.removesuffix(b"\f").split(b"\f"):
        yield page.decode()


def page_folder(t) -> str:
    """Documents as pages of files, one folder per source, at most 50 pages in a file."""
    path = fresh_path(t.spark, "page-files")
    t.documents.select("source", "text").write.option("maxRecordsPerFile", 50).option("lineSep", "\f").partitionBy("source").text(path)
    return path


@query(
    "x4_page_extractor",
    """SELECT source, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS n_chars, count(*) AS n_pages FROM documents GROUP BY ALL""",
)
def _(t):
    files = H.read_files(t.spark, page_folder(t), "*.txt")
    pages = H.extract_pages(files, form_feeds).filter("error IS NULL")
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    return pages.groupBy(source.alias("source"), F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars")).agg(F.count("*").alias("n_pages"))
