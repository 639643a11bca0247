"""Sources and sinks: files and documents written by Spark from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.text import clean_text
from convolake.operators import fragments as Fr
from convolake.plans.registry import query
from convolake.plans.text import clean_sql
from convolake.plans.trees import LINEAR_SQL
from convolake.session import fresh_path
from convolake.sources import exports as E
from convolake.sources import files as S
from convolake.sources import imports as I


@query(
    "s1_question_answers",
    """SELECT 'SORU: ' || q || chr(10) || chr(10) || 'CEVAP: ' || a AS content, coalesce(nullif(c, ''), 'genel') AS category, '' AS keywords, 'qa_pair' AS type
       FROM (SELECT source || ' "' || doc_id || '"' AS q, CASE WHEN doc_id % 5 <> 0 THEN text END AS a, CASE WHEN doc_id % 2 = 0 THEN lang END AS c FROM documents)
       WHERE a IS NOT NULL AND a <> ''""",
)
def _(t):
    path, k = fresh_path(t.spark, "qa"), F.col("doc_id")
    t.documents.select(
        F.concat("source", F.lit(' "'), k.cast("string"), F.lit('"')).alias("soru"),
        F.when(k % 5 != 0, F.col("text")).alias("cevap"),
        F.when(k % 2 == 0, F.col("lang")).alias("kategori"),
        F.lit("").alias("anahtar_kelimeler"),
    ).write.csv(path, header=True, quoteAll=True, escape='"')
    return S.read_qa_csv(t.spark, path)


def text_folder(t) -> str:
    """Documents as text files below one folder per source, at most 100 documents in a file."""
    path = fresh_path(t.spark, "texts")
    t.documents.select("source", "text").write.option("maxRecordsPerFile", 100).partitionBy("source").text(path)
    return path


@query(
    "s2_whole_texts",
    "SELECT source, sum(length(text) + 1) AS chars, 'text_document' AS type FROM documents GROUP BY source",
)
def _(t):
    texts = S.read_texts(t.spark, text_folder(t) + "/*/*.txt")
    return texts.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "type").agg(
        F.sum(F.length("content")).cast("bigint").alias("chars")
    )


@query("s3_list_files", "SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, ceil(count(*) / 100)::BIGINT <= count(*) AS accepted FROM documents GROUP BY source")
def _(t):
    files = S.list_files(t.spark, text_folder(t))
    return files.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(
        F.sum("length").alias("bytes"), (F.count_distinct("path") <= F.sum("length")).alias("accepted")
    )


@query(
    "s4_new_files",
    """SELECT doc_id, source || '/' || doc_id || '.txt' AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(t):
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = t.documents.select("doc_id", name.alias("name"))
    loaded = files.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return S.new_files(files, loaded).select("doc_id", "name")


_PAGE_TEXT = "regexp_replace(html, '<[^>]*>', ' ', 'g')"


def page_text():
    return F.regexp_replace("html", "<[^>]*>", " ")


@query(
    "s6_page_rows",
    f"SELECT page_id, url, {clean_sql('t')} AS text FROM (SELECT page_id, url, {_PAGE_TEXT} AS t FROM pages) WHERE length(t) > 10",
)
def _(t):
    return S.page_rows(t.pages.select("page_id", "url", page_text().alias("text")), "text")


@query(
    "s7_page_routing",
    f"""SELECT page_id, n_images > 0 OR length(trim(t)) < 50 AS needs_ocr FROM (SELECT page_id,
          CAST(length(html) - length(replace(html, '<nav', '<na')) AS INTEGER) AS n_images, {_PAGE_TEXT} AS t FROM pages)""",
)
def _(t):
    marks = F.length("html") - F.length(F.replace("html", F.lit("<nav"), F.lit("<na")))
    return t.pages.select("page_id", S.needs_ocr(marks, page_text()).alias("needs_ocr"))


@query("s8_image_only", f"SELECT doc_id, length({clean_sql('text')}) < 10 AS image_only FROM documents")
def _(t):
    return t.documents.select("doc_id", (F.length(clean_text(F.col("text"))) < 10).alias("image_only"))


@query(
    "s9_json_format",
    """SELECT doc_id, ['node_map', 'history', 'tree', 'unsupported', 'unsupported'][CAST(doc_id % 5 + 1 AS INTEGER)] AS format FROM documents""",
)
def _(t):
    text = F.to_json(F.struct(F.col("text").alias("t")))
    k = F.col("doc_id") % 5
    wrap = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    document = (
        F.when(k == 0, wrap("[", "]"))
        .when(k == 1, wrap('{"version":4,"history":[', "]}"))
        .when(k == 2, wrap('{"conversationId":"c","messages":[', "]}"))
        .when(k == 3, wrap('{"version":4,"other":', "}"))
        .otherwise(F.concat(F.lit("{broken "), "text"))
    )
    return t.documents.select("doc_id", I.json_format(document).alias("format"))


def node_documents(t):
    """Node-map exports, one per conversation."""
    turn = F.col("turn")
    ident = lambda n: F.concat(F.lit("n"), n.cast("string"))
    message = F.struct(
        F.struct(F.col("role").alias("role")).alias("author"),
        F.struct(F.lit("text").alias("content_type"), F.split("text", r"\. ").alias("parts")).alias("content"),
        F.struct(F.when(turn % 3 == 0, "gpt-4-turbo").when(turn % 3 == 1, "text-model").alias("model_slug")).alias("metadata"),
    )
    node = F.struct(ident(turn).alias("id"), message.alias("message"), F.when(turn > 0, ident(turn - 1)).alias("parent"))
    entry = F.concat(F.lit('"'), ident(turn), F.lit('":'), F.to_json(node))
    parts = Fr.fragments(t.conversations, ["conv_id"], ["turn"], F.floor(turn / 512), entry)
    head = F.concat(F.lit('[{"title":"c'), F.col("conv_id").cast("string"), F.lit('","create_time":1700000000.5,"mapping":{'))
    return Fr.whole(parts, ["conv_id"], ",").select(F.col("conv_id").alias("doc"), F.concat(head, "value", F.lit("}}]")).alias("json"))


@query(
    "s10_import_node_map",
    """SELECT conv_id AS doc, 'n' || turn AS source_id,
          CASE WHEN EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role <> 'system') THEN 'n' || (turn - 1) END AS source_parent,
          CASE WHEN turn % 3 <> 1 THEN 'GPT-4' WHEN role = 'user' THEN 'user' ELSE 'GPT-3.5' END AS sender,
          ['gpt-4-turbo', 'text-model', 'gpt-4o-mini'][CAST(turn % 3 + 1 AS INTEGER)] AS model, replace(text, '. ', ' ') AS text,
          CAST('2023-11-14 22:13:20.5' AS VARCHAR) AS created
        FROM conversations c WHERE role <> 'system'""",
)
def _(t):
    rows = I.import_node_map(node_documents(t), "doc", "json")
    return rows.select(
        "doc", "source_id", "source_parent", "sender", "model", "text", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.S").alias("created")
    )


@query(
    "s11_import_history",
    f"""WITH s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
          FROM conversations WHERE role IN ('user', 'assistant'))
        SELECT conv_id AS doc, pos, conv_id || '-0-' || pos AS message_id,
          CASE WHEN pos = 0 THEN '{I.NO_PARENT}' ELSE conv_id || '-0-' || (pos - 1) END AS parent_id, role, text FROM s""",
)
def _(t):
    message = F.to_json(F.struct("role", F.col("text").alias("content")))
    parts = Fr.fragments(t.conversations, ["conv_id"], ["turn"], F.floor(F.col("turn") / 512), message)
    docs = Fr.whole(parts, ["conv_id"], ",").select(
        F.col("conv_id").alias("doc"), F.concat(F.lit('{"version":4,"history":[{"id":"h","name":"n","messages":['), "value", F.lit("]}]}")).alias("json")
    )
    return I.import_history(docs, "doc", "json").select("doc", "pos", "message_id", "parent_id", "role", "text")


def tree_documents(t):
    nested = E.nested_documents(t.messages().drop("summary", "tokens"), F.lit("t"))
    return nested.select(F.col("conv_id").alias("doc"), "json")


@query(
    "g6_flatten_tree",
    f"""WITH RECURSIVE {LINEAR_SQL} SELECT m.conv_id AS doc, CAST(m.msg AS VARCHAR) AS message_id,
          CASE WHEN m.parent = -1 THEN '{I.NO_PARENT}' ELSE CAST(m.parent AS VARCHAR) END AS parent_id, m.role AS sender, m.text, len(p.path) - 1 AS depth,
          m.created_at
        FROM msg m JOIN pre p USING (conv_id, msg)""",
)
def _(t):
    _, messages = I.import_tree(tree_documents(t), "doc", "json")
    return messages.drop("node")


_GAPS = """gap AS (SELECT * REPLACE (CASE WHEN (conv_id + msg) % 9 = 4 THEN '' ELSE text END AS text, CASE WHEN msg % 3 <> 0 THEN created_at END AS created_at) FROM msg)"""


def gappy(t):
    """Messages of which some are empty and some without a date."""
    m = t.messages().drop("summary", "tokens")
    return m.withColumns({"text": F.when((F.col("conv_id") + F.col("msg")) % 9 == 4, "").otherwise(F.col("text")), "dated": F.when(F.col("msg") % 3 != 0, F.col("created_at"))})


@query(
    "s12_import_tree",
    f"""WITH RECURSIVE {LINEAR_SQL}, {_GAPS},
        kept AS (SELECT conv_id, msg FROM gap WHERE parent = -1 AND text <> ''
          UNION ALL SELECT g.conv_id, g.msg FROM kept k JOIN gap g ON g.conv_id = k.conv_id AND g.parent = k.msg WHERE g.text <> '')
        SELECT c.conv_id AS doc, CASE WHEN c.conv_id % 2 = 0 THEN 'Chat "' || c.conv_id || '"' ELSE 'Imported Chat' END AS title,
          arg_min(g.created_at, l.position) FILTER (g.created_at IS NOT NULL) AS created_at, count(g.msg) AS n_messages
        FROM (SELECT DISTINCT conv_id FROM msg) c LEFT JOIN kept k ON k.conv_id = c.conv_id LEFT JOIN gap g ON g.conv_id = k.conv_id AND g.msg = k.msg
        LEFT JOIN lin l ON l.conv_id = g.conv_id AND l.msg = g.msg GROUP BY c.conv_id""",
)
def _(t):
    """Exported and imported again: the title's default, the first date of the messages kept, their number."""
    head = E.message_head(F.date_format("dated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    title = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('Chat "'), F.col("conv_id").cast("string"), F.lit('"'))).otherwise("")
    docs = E.nested_documents(gappy(t), title, head).select(F.col("conv_id").alias("doc"), "json")
    heads, messages = I.import_tree(docs, "doc", "json")
    n = messages.groupBy("doc").agg(F.count("*").alias("n_messages"))
    return heads.join(n, "doc", "left").select("doc", "title", "created_at", F.coalesce("n_messages", F.lit(0)).alias("n_messages"))


@query(
    "s13_append_sink",
    "SELECT doc_id, count(*) AS n, max(content) AS content FROM (SELECT doc_id, text AS content FROM documents UNION ALL SELECT doc_id, '' FROM labels) GROUP BY doc_id",
)
def _(t):
    path = fresh_path(t.spark, "knowledge")
    S.append(t.documents.select("doc_id", F.col("text").alias("content")), path)
    S.append(t.labels.select("doc_id", F.lit("").alias("content")), path)
    return t.spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("content").alias("content"))


@query("s14_truncate_sink", "SELECT doc_id, text FROM documents WHERE FALSE")
def _(t):
    path = fresh_path(t.spark, "knowledge")
    rows = t.documents.select("doc_id", "text")
    S.append(rows, path)
    S.truncate(t.spark, rows, path)
    return t.spark.read.parquet(path)


@query(
    "s15_csv_export",
    f"""WITH RECURSIVE {LINEAR_SQL} SELECT conv_id, role AS sender, text, role = 'user' AS "isCreatedByUser", FALSE AS error, FALSE AS unfinished,
          msg AS "messageId", parent AS "parentMessageId", strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') AS "createdAt" FROM msg""",
)
def _(t):
    path = fresh_path(t.spark, "csv")
    E.write_csv(t.messages(), path)
    shape = (
        "conv_id BIGINT, sender STRING, text STRING, isCreatedByUser BOOLEAN, error BOOLEAN, unfinished BOOLEAN, "
        "messageId BIGINT, parentMessageId BIGINT, createdAt STRING"
    )
    rows = t.spark.read.csv(path, schema=shape, header=True, multiLine=True, escape='"')
    return rows.withColumn("createdAt", F.date_format(F.to_timestamp_ntz("createdAt"), "yyyy-MM-dd'T'HH:mm:ss.SSS"))


@query(
    "s16_json_export",
    f"""WITH RECURSIVE {LINEAR_SQL} SELECT conv_id, position, msg, parent, role, text FROM msg JOIN lin USING (conv_id, msg)""",
)
def _(t):
    lines = E.json_lines(t.messages(), ["msg", "parent", "role", "text"])
    shape = "struct<msg:bigint,parent:bigint,role:string,text:string>"
    return lines.select("conv_id", "position", F.from_json("json", shape).alias("j")).select("conv_id", "position", "j.*")


@query(
    "s16_json_nested",
    f"""WITH RECURSIVE {LINEAR_SQL}, f AS (SELECT m.*, position, len(path) - 1 AS level, path[-1] AS sibling FROM msg m JOIN lin USING (conv_id, msg) JOIN pre USING (conv_id, msg)),
        g AS (SELECT *, lead(level, 1, 0) OVER (PARTITION BY conv_id ORDER BY position) AS next FROM f)
        SELECT conv_id, count(*) AS n, md5('{{"conversationId":"' || conv_id || '","title":"t","recursive":true,"messagesTree":[' || string_agg(
          CASE WHEN sibling > 0 THEN ',' ELSE '' END || '{{"messageId":"' || msg || '","text":' || to_json(text)::VARCHAR || ',"sender":"' || role || '","createdAt":"'
          || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') || '","children":[' || repeat(']}}', level - next + 1), '' ORDER BY position) || ']}}') AS json_md5
        FROM g GROUP BY conv_id""",
)
def _(t):
    return E.nested_documents(t.messages(), F.lit("t")).select("conv_id", "n", F.md5("json").alias("json_md5"))


def transcript_sql(head: str, body: str) -> str:
    return f"""WITH RECURSIVE {LINEAR_SQL} SELECT conv_id, position, {body} AS line FROM msg JOIN lin USING (conv_id, msg) WHERE on_last_branch
      UNION ALL SELECT DISTINCT conv_id, -1, {head} FROM msg"""


@query(
    "s17_markdown_transcript",
    transcript_sql(
        "'# Conversation' || chr(10) || '- conversationId: ' || conv_id || chr(10) || chr(10) || '## History'",
        "'**' || role || '**' || chr(10) || text",
    ),
)
def _(t):
    return E.transcript(t.messages())


@query(
    "s17_text_transcript",
    transcript_sql(
        "'Conversation' || chr(10) || repeat('#', 24) || chr(10) || 'conversationId: ' || conv_id || chr(10) || chr(10) || 'History' || chr(10) || repeat('#', 24)",
        "'>> ' || role || ':' || chr(10) || text",
    ),
)
def _(t):
    return E.transcript(t.messages(), "text")


@query(
    "s20_ocr_document",
    f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '# PAGE 1' || chr(10) || t || chr(10) || chr(10) || '# PAGE 2' || chr(10) || url || chr(10) || chr(10)
          ELSE t || chr(10) || chr(10) END AS text, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS n_images,
          4 * CASE WHEN page_id % 2 = 0 THEN length(t) + length(url) + 22 ELSE length(t) + 2 END AS bytes
        FROM (SELECT page_id, url, {_PAGE_TEXT} AS t FROM pages)""",
)
def _(t):
    page = lambda text, images: F.struct(text.alias("markdown"), images.alias("images"))
    none = F.array().cast("array<string>")
    pages = F.when(
        F.col("page_id") % 2 == 0,
        F.array(page(F.col("t"), none), page(F.col("url"), F.array(F.col("url"), F.lit("")))),
    ).otherwise(F.array(page(F.col("t"), none)))
    return (
        t.pages.select("page_id", "url", page_text().alias("t"))
        .select("page_id", S.ocr_document(pages).alias("d"))
        .select(
            "page_id", "d.text", F.size("d.images").cast("bigint").alias("n_images"), F.col("d.bytes").cast("bigint").alias("bytes")
        )
    )
