"""Text and value functions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions import content as C
from convolake.functions import text as X
from convolake.functions.chunks import chunks, with_cut_text
from convolake.functions.fixed import RETENTION_DEFAULT, RETENTION_MAX, RETENTION_MIN
from convolake.operators import fragments as Fr
from convolake.operators import scan
from convolake.plans.registry import query
from convolake.session import spread
from convolake.sources.tables import MSG_SQL

S = X.SPACE_RE2


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def clean_sql(x: str) -> str:
    for pattern, new in (("\\r\\n", "\\n"), ("\\r", "\\n"), ("\\n{3,}", "\\n\\n"), (f"[{S}]{{2,}}", " "), ("\\t", " ")):
        x = f"regexp_replace({x}, '{pattern}', E'{new}', 'g')"
    return trim_sql(x)


def tokens_sql(x: str) -> str:
    return f"CAST(ceil(len(string_split({x}, ' ')) * CAST(1.3 AS DOUBLE)) AS BIGINT)"


SENTENCES_SQL = (
    "list_filter(list_transform(regexp_split_to_array(replace(text, 'T.C', 'T_TEMP_C'), '[.!?\\n]+'), "
    f"lambda s: replace({trim_sql('s')}, 'T_TEMP_C', 'T.C')), lambda s: length(s) > 0)"
)


def docs(t, *columns):
    return spread(t.documents.select("doc_id", *columns))


@query("t1_clean_text", f"SELECT doc_id, clean, length(clean) AS n FROM (SELECT doc_id, {clean_sql('text')} AS clean FROM documents)")
def _(t):
    return (
        docs(t, "text")
        .select("doc_id", X.clean_text(F.col("text")).alias("clean"))
        .withColumn("n", F.length("clean").cast("bigint"))
    )


@query(
    "t2_sentences",
    f"SELECT doc_id, unnest({SENTENCES_SQL}) AS sentence, generate_subscripts({SENTENCES_SQL}, 1) - 1 AS pos FROM documents",
)
def _(t):
    return docs(t, "text").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query("t3_token_count", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


# Lines of a conversation text as content parts of four types in turn.
PARTS_SQL = """lines AS (SELECT conv_id, turn, role, unnest(string_split(text, E'\\n')) AS x,
    generate_subscripts(string_split(text, E'\\n'), 1) - 1 AS i FROM conversations),
parts AS (SELECT *, CASE i % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'think' WHEN 2 THEN 'tool_call' ELSE 'error' END AS type
          FROM lines)"""


def part_rows(t):
    kind = lambda i: (
        F.when(i % 4 == 0, "text").when(i % 4 == 1, "think").when(i % 4 == 2, "tool_call").otherwise("error")
    )
    part = lambda x, i: F.struct(
        kind(i).alias("type"),
        F.when(i % 4 == 0, x).alias("text"),
        F.when(i % 4 == 1, x).alias("think"),
        F.when(i % 4 == 2, "search").alias("name"),
        F.when(i % 4 == 2, x).alias("args"),
        F.when(i % 4 == 2, F.replace(x, F.lit("a"), F.lit("b"))).alias("output"),
        (i % 8 == 0).alias("announces"),
    )
    return t.conversations.select(
        "conv_id", "turn", "role", "text", F.transform(F.split("text", "\n"), part).alias("parts")
    )


@query(
    "t4_message_tokens",
    f"""WITH {PARTS_SQL} SELECT conv_id, turn, 3 + {tokens_sql('any_value(role)')} + CAST(sum(CASE WHEN x = '' AND type = 'text'
        THEN 0 WHEN type = 'text' THEN {tokens_sql('x')} WHEN type = 'tool_call' THEN 2 + CASE WHEN x = '' THEN 0 ELSE
        2 * {tokens_sql('x')} END ELSE 0 END) AS BIGINT) AS tokens FROM parts GROUP BY conv_id, turn""",
)
def _(t):
    return part_rows(t).select("conv_id", "turn", C.message_tokens(F.col("role"), F.col("parts")).alias("tokens"))


_CHUNKS_SQL = f"""WITH RECURSIVE s AS (SELECT doc_id, {SENTENCES_SQL} AS ss FROM documents),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS emit, '' AS cur, CAST(0 AS BIGINT) AS tok FROM s
  UNION ALL SELECT doc_id, i + 1,
    CASE WHEN n > 750 THEN list_concat(CASE WHEN cur <> '' THEN [cur] ELSE CAST([] AS VARCHAR[]) END, list_transform(
        range(0, CAST((len(w) - 1) // 375 + 1 AS BIGINT)), lambda j: array_to_string(w[j * 375 + 1 : j * 375 + 375], ' ')))
      WHEN tok + n > 750 THEN [cur] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN n > 750 THEN '' WHEN tok + n > 750 THEN tail || ' ' || x WHEN cur <> '' THEN cur || ' ' || x ELSE x END,
    CASE WHEN n > 750 THEN 0 WHEN tok + n > 750 THEN {tokens_sql("tail || ' ' || x")} ELSE tok + n END
  FROM (SELECT *, {tokens_sql('x')} AS n, string_split(x, ' ') AS w, CASE WHEN {tokens_sql('cur')} <= 100 THEN cur
          ELSE array_to_string(string_split(cur, ' ')[-77:], ' ') END AS tail
        FROM (SELECT r.*, ss[i + 1] AS x FROM r JOIN s USING (doc_id) WHERE i < len(ss)))),
e AS (SELECT doc_id, i, unnest(emit) AS c, generate_subscripts(emit, 1) AS p FROM r
  UNION ALL SELECT doc_id, 1000000000, arg_max(cur, i), 1 FROM r GROUP BY doc_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, p) - 1 AS chunk_index, content, {tokens_sql('content')} AS tokens
FROM (SELECT doc_id, i, p, {trim_sql('c')} AS content FROM e) WHERE content <> ''"""


def chunk_parts(t):
    """(doc_id, n_chunks, chunk_index, content). The outer form: the other one filters by the chunks below the dealing, in few tasks, and makes them twice."""
    parts = docs(t, "text").select("doc_id", chunks(F.col("text")).alias("parts"))
    rows = parts.select("doc_id", F.size("parts").cast("bigint").alias("n_chunks"), F.posexplode_outer("parts").alias("chunk_index", "content"))
    return rows.filter("content IS NOT NULL")


@query("t5_chunks", _CHUNKS_SQL)
def _(t):
    return chunk_parts(t).select("doc_id", "chunk_index", "content", X.token_estimate(F.col("content")).alias("tokens"))


@query("w4_chunk_index", f"SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS n_chunks, md5(content) AS content_md5, tokens FROM ({_CHUNKS_SQL})")
def _(t):
    return chunk_parts(t).select("doc_id", "chunk_index", "n_chunks", F.md5("content").alias("content_md5"), X.token_estimate(F.col("content")).alias("tokens"))


_OCR_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  CASE doc_id % 4 WHEN 0 THEN 'Extracted text: ' WHEN 1 THEN 'Here is the extracted text: ' ELSE '' END ||
  CASE doc_id % 3 WHEN 0 THEN E'```md\n' || text || E'\n``` end' ELSE text || ' [N/A] [ ... ]  x' END,
  '^(?i:Here is the extracted.*?:\s*)', ''), '^(?i:Extracted text:\s*)', ''),
  '(?s)^.*?```[a-zA-Z0-9]*\n(.*?)\n```.*$', '\1'),
  '\[\s*(?i:N/A|NA|None|Null|Empty|Blank|TBD|Missing|Unknown)\s*\]', '', 'g'), '\[\s*[-_.…\s]*\s*\]', '', 'g'), '[ \t]+', ' ', 'g')"""


def ocr_clean(text):
    # Lead-in phrases and placeholders of extracted text.
    for lead in (
        "Here is the extracted.*?:", "Extracted text:", "The extracted.*?:", "Bu görseldeki.*?çıkarılabilir:",
        "Bu resimdeki.*?çıkarılabilir:", "Görseldeki.*?çıkarılabilir:", "İşte.*?metin:", "Metinler şu şekilde:",
        "Aşağıdaki metin.*?:",
    ):
        text = F.regexp_replace(text, f"^(?iu:{lead}\\s*)", "")
    text = F.regexp_replace(text, r"(?s)\A.*?```[a-zA-Z0-9]*\n(.*?)\n```.*\z", "$1")
    blanks = (
        "Gönderilmemiş|Boş|Doldurulmamış|N/A|NA|None|Null|Empty|Blank|TBD|To be determined|Belirtilmemiş|Yazılmamış|"
        r"Eksik|Missing|Unknown|Bilinmiyor|Yok|---|\.\.\.|…|_+|-+|\s+"
    )
    text = F.regexp_replace(text, rf"\[\s*(?iu:{blanks})\s*\]", "")
    text = F.regexp_replace(text, r"\[\s*[-_.…\s]*\s*\]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), "\n{3,}", "\n\n")
    return X.trim_space(text)


@query(
    "t11_ocr_clean",
    f"SELECT doc_id, {trim_sql(f'regexp_replace({_OCR_SQL}, chr(10) || chr(123) || 3::VARCHAR || chr(44) || chr(125), chr(10) || chr(10), chr(103))')} AS clean FROM documents",
)
def _(t):
    k = F.col("doc_id")
    lead = F.when(k % 4 == 0, "Extracted text: ").when(k % 4 == 1, "Here is the extracted text: ").otherwise("")
    body = F.when(k % 3 == 0, F.concat(F.lit("```md\n"), "text", F.lit("\n``` end"))).otherwise(
        F.concat("text", F.lit(" [N/A] [ ... ]  x"))
    )
    return docs(t, "text").select("doc_id", ocr_clean(F.concat(lead, body)).alias("clean"))


@query(
    "t12_truncate",
    """SELECT doc_id, CASE WHEN length(text) > 255 THEN left(text, 255) || '... [text truncated for brevity]' ELSE text END AS head,
         CASE WHEN length(text) > 255 THEN left(text, 111) || '...' || right(text, 111) || ' [text truncated for brevity]'
         ELSE text END AS middle FROM documents""",
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", X.truncate_with_notice(text).alias("head"), X.middle_truncate(text).alias("middle")
    )


_JOIN = """list_reduce(list_prepend('', list(x ORDER BY i) FILTER ({0})), lambda a, b: a || CASE WHEN length(a) > 0
  AND length(b) > 0 AND right(a, 1) <> ' ' AND left(b, 1) <> ' ' THEN ' ' ELSE '' END || b)"""


@query(
    "t13_parts_to_text",
    f"""WITH {PARTS_SQL} SELECT conv_id, turn, {trim_sql("string_agg(x, ' ' ORDER BY i) FILTER (type = 'text')")} AS plain,
          {_JOIN.format("type IN ('text', 'think')")} AS spaced, {_JOIN.format("type = 'text'")} AS spoken
        FROM parts GROUP BY conv_id, turn""",
)
def _(t):
    p = F.col("parts")
    return part_rows(t).select(
        "conv_id",
        "turn",
        C.plain_text(p).alias("plain"),
        C.spaced_text(p).alias("spaced"),
        C.spaced_text(p, skip_reasoning=True).alias("spoken"),
    )


@query(
    "t14_collapse_text",
    f"""WITH {PARTS_SQL} SELECT conv_id, turn, CASE WHEN bool_and(type = 'text') THEN
          {trim_sql("string_agg(x, chr(10) ORDER BY i)")} END AS text, count(*) AS n_parts FROM parts GROUP BY conv_id, turn""",
)
def _(t):
    p = F.col("parts")
    return part_rows(t).select("conv_id", "turn", C.collapsed(p).alias("text"), F.size(p).cast("bigint").alias("n_parts"))


@query(
    "t15_typed_bodies",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN array_to_string(string_split(text, '. '), ' ')
         WHEN 1 THEN '```py' || chr(10) || text || chr(10) || '```' WHEN 2 THEN 'Execution Output:' || chr(10) || '> ' || text
         ELSE '```json' || chr(10) || CAST(to_json({content_type: 'other', n: length(text)}) AS VARCHAR) || chr(10) || '```' END AS body
       FROM conversations""",
)
def _(t):
    from convolake.sources.imports import message_body

    kind = F.element_at(F.array(*map(F.lit, ["text", "code", "execution_output", "other"])), (F.col("turn") % 4 + 1).cast("int"))
    shape = F.struct(
        kind.alias("content_type"),
        F.split("text", r"\. ").alias("parts"),
        F.lit("py").alias("language"),
        F.col("text").alias("text"),
    )
    fallback = F.to_json(F.struct(kind.alias("content_type"), F.length("text").alias("n")))
    return t.conversations.select("conv_id", "turn", message_body(shape, fallback).alias("body"))


_CITED = """c AS (SELECT doc_id, text, source, least(length(text), 5 + doc_id % 50) AS a, length(text) AS n FROM documents)"""


@query(
    "t16_citation_splice",
    f"""WITH {_CITED} SELECT doc_id, CASE WHEN a < n THEN left(text, a) || ' ([' || source || '](https://x.test/' || doc_id || '))'
          ELSE text END AS text FROM c""",
)
def _(t):
    from convolake.sources.imports import cite

    n = F.length("text")
    a = F.least(n, (5 + F.col("doc_id") % 50).cast("int"))
    citation = lambda kind, start, end: F.struct(
        F.lit(kind).alias("type"),
        start.cast("int").alias("start_ix"),
        end.cast("int").alias("end_ix"),
        F.col("source").alias("title"),
        F.concat(F.lit("https://x.test/"), F.col("doc_id").cast("string")).alias("url"),
    )
    citations = F.array(
        citation("image", F.lit(0), F.lit(2)), citation("webpage", a, n), citation("webpage", n, n)
    )
    return docs(t, "text", "source").select("doc_id", cite(F.col("text"), citations).alias("text"))


@query(
    "t17_citation_markers",
    """SELECT doc_id, '**' || source || '** ' || text || '[1] and [1][2] end' AS text,
         CASE WHEN doc_id % 3 = 1 THEN '[1] ' || source || chr(10) || '[2] ' || lang ELSE '[1] ' || lang || chr(10) || '[2] ' || source END
         AS citations FROM documents""",
)
def _(t):
    from convolake.operators.citations import number_citations

    # documents carry markers to their own source list: three sources, two of which share an address
    k = F.col("doc_id")
    ref = lambda i: F.concat(F.lit(r"\ue202turn0search"), i.cast("string"))
    marked = F.concat(
        F.lit(r"\ue203"), "source", F.lit(r"\ue204 "), "text", ref(k % 3), F.lit(r" and \ue200"), ref(F.lit(1)), ref(F.lit(2)),
        F.lit(r"\ue201 end "), ref(F.lit(7)),
    )
    texts = t.documents.select("doc_id", marked.alias("text"))
    sources = t.documents.select(
        "doc_id",
        F.posexplode(F.array(F.col("lang"), F.col("source"), F.col("lang"))).alias("idx", "link"),
    ).select("doc_id", F.lit(0).alias("turn"), F.lit("search").alias("kind"), "idx", "link")
    return number_citations(texts, sources, "doc_id")


@query(
    "t18_artifacts",
    """SELECT doc_id, 0 AS n, 6 AS start, 6 + 11 + length(source) + 1 + length(body) + 4 AS "end" FROM (
         SELECT doc_id, source, replace(text, ':::', '') AS body FROM documents)
       UNION ALL SELECT doc_id, 1, 6 + 11 + length(source) + 1 + length(body) + 4 + 5,
         6 + 11 + length(source) + 1 + length(body) + 4 + 5 + 11 + 5 FROM (
         SELECT doc_id, source, replace(text, ':::', '') AS body FROM documents)""",
)
def _(t):
    from convolake.operators.citations import artifacts

    body = F.replace("text", F.lit(":::"), F.lit(""))
    text = F.concat(
        F.lit("Intro "), F.lit(":::artifact"), "source", F.lit("\n"), body, F.lit("\n:::"), F.lit(" then"),
        F.lit(":::artifact open"),
    )
    return docs(t, "text", "source").select("doc_id", F.posexplode(artifacts(text)).alias("n", "a")).select(
        "doc_id", "n", F.col("a.start").alias("start"), F.col("a.end").alias("end")
    )


@query(
    "t18_artifact_replace",
    """SELECT doc_id, 'Intro :::artifact' || source || chr(10) || '```' || chr(10) || 'new ' || lang || chr(10) || lang ||
         ' tail' || chr(10) || '```' || chr(10) || ':::' || text AS text FROM documents""",
)
def _(t):
    from convolake.operators.citations import replace_in_artifact

    text = F.concat(
        F.lit("Intro :::artifact"), "source", F.lit("\n```\nold "), "lang", F.lit("\n"), "lang",
        F.lit(" tail\n```\n:::"), "text",
    )
    old = F.concat(F.lit("old "), "lang", F.lit("\n"))
    new = F.concat(F.lit("new "), "lang")
    return docs(t, "text", "source", "lang").select("doc_id", replace_in_artifact(text, 0, old, new).alias("text"))


@query(
    "t19_template_variables",
    """SELECT doc_id, lang || ',' || source || ',current_date,' || lang AS all_variables,
         array_to_string(list_filter(['current_date', lang, source], lambda x: TRUE), ',') AS ordered_unique, lang AS repeated,
         TRUE AS has_own FROM documents""",
)
def _(t):
    from convolake.operators.citations import template_variables

    text = F.concat(
        "text", F.lit(" {{"), "lang", F.lit("}} {{"), "source", F.lit("}} {{current_date}} {{"), "lang", F.lit("}}")
    )
    v = template_variables(text)
    return docs(t, "text", "lang", "source").select("doc_id", v.alias("v")).select(
        "doc_id",
        F.array_join("v.all", ",").alias("all_variables"),
        F.array_join(F.array_sort("v.unique"), ",").alias("ordered_unique"),
        F.array_join("v.repeated", ",").alias("repeated"),
        F.col("v.has_own").alias("has_own"),
    )


_SECRETS = """CASE doc_id % 3 WHEN 0 THEN 'sk-' || md5(text) || ' ' || text WHEN 1 THEN text || ' Bearer ' || md5(text) || ' k?key=' || md5(text)
         ELSE text || ' api-key: ' || md5(text) END"""


def redact_sql(x: str) -> str:
    for lead in ("^(sk-)", "(Bearer )", "(api-key:? )", "(key=)"):
        x = f"regexp_replace({x}, '{lead}[^{S}]+', '\\1[REDACTED]')"
    return x


@query("t21_redact", f"SELECT doc_id, {redact_sql('x')} AS redacted FROM (SELECT doc_id, {_SECRETS} AS x FROM documents)")
def _(t):
    k, text, secret = F.col("doc_id"), F.col("text"), F.md5("text")
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit("sk-"), secret, F.lit(" "), text))
        .when(k % 3 == 1, F.concat(text, F.lit(" Bearer "), secret, F.lit(" k?key="), secret))
        .otherwise(F.concat(text, F.lit(" api-key: "), secret))
    )
    return t.documents.select("doc_id", X.redact(raw).alias("redacted"))


@query("t22_cut_text")
def _(t):
    return with_cut_text(docs(t, "text"), "doc_id", "text")


@query(
    "t25_anonymised",
    f"""WITH {MSG_SQL} SELECT 'convo_' || left(sha256('salt|c|' || conv_id), 21) AS conversation_id,
          'msg_' || left(sha256('salt|m|' || conv_id || '-' || msg), 21) AS message_id,
          CASE WHEN parent = -1 THEN '-1' ELSE 'msg_' || left(sha256('salt|m|' || conv_id || '-' || parent), 21) END AS parent_id,
          text FROM msg""",
)
def _(t):
    from convolake.operators.merge import anonymous

    m = t.messages()
    return m.select(
        anonymous("convo", "c", F.col("conv_id").cast("string")).alias("conversation_id"),
        anonymous("msg", "m", F.concat_ws("-", "conv_id", "msg")).alias("message_id"),
        F.when(F.col("parent") == -1, "-1")
        .otherwise(anonymous("msg", "m", F.concat_ws("-", "conv_id", "parent")))
        .alias("parent_id"),
        "text",
    )


@query(
    "t26_retention",
    """SELECT event_id, hours, ts + to_hours(CAST(hours AS INTEGER)) AS expires_at FROM (SELECT event_id, ts, CAST(greatest(1, least(8760,
         coalesce(CASE WHEN event_type <> 'view' THEN CAST(floor(value * 30) AS BIGINT) - 50 END, 720))) AS BIGINT) AS hours FROM events)""",
)
def _(t):
    asked = F.when(F.col("event_type") != "view", F.floor(F.col("value") * 30) - 50)
    hours = F.greatest(F.lit(RETENTION_MIN), F.least(F.lit(RETENTION_MAX), F.coalesce(asked, F.lit(RETENTION_DEFAULT))))
    return t.events.select(
        "event_id",
        hours.cast("bigint").alias("hours"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), hours.cast("int"))).alias("expires_at"),
    )


@query(
    "t27_date_formats",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso_date,
         month(ts) || '/' || day(ts) || '/' || year(ts) || ', ' || CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END
         || strftime(ts, ':%M:%S ') || CASE WHEN hour(ts) >= 12 THEN 'PM' ELSE 'AM' END AS us FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("iso_date"),
        F.date_format("ts", "M/d/yyyy, h:mm:ss a").alias("us"),
    )


@query(
    "t29_default_titles",
    """SELECT doc_id, coalesce(nullif(title, ''), 'New Chat') AS listed, coalesce(nullif(title, ''), 'Untitled') AS shared,
         coalesce(nullif(title, ''), 'Imported Chat') AS imported
       FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source END AS title FROM documents)""",
)
def _(t):
    k = F.col("doc_id")
    title = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("source"))
    # Default titles.
    return t.documents.select(
        "doc_id",
        X.title_or(title, "New Chat").alias("listed"),
        X.title_or(title, "Untitled").alias("shared"),
        X.title_or(title, "Imported Chat").alias("imported"),
    )


@query(
    "t31_metadata_hash",
    """SELECT p_partkey, sha256('a' || p_partkey % 10 || ':{brand:"' || p_brand || '",size:' || p_size || ',type:"' || p_type || '"};b'
         || p_partkey % 7 || ':null') AS hash FROM part""",
)
def _(t):
    from convolake.operators.merge import metadata_hash

    entry = lambda key, meta: F.struct(key.alias("id"), meta.alias("meta"))
    meta = F.create_map(
        F.lit("type"), F.concat(F.lit('"'), "p_type", F.lit('"')),
        F.lit("size"), F.col("p_size").cast("string"),
        F.lit("brand"), F.concat(F.lit('"'), "p_brand", F.lit('"')),
    )
    k = F.col("p_partkey")
    entries = F.array(
        entry(F.concat(F.lit("b"), (k % 7).cast("string")), F.lit(None).cast("map<string,string>")),
        entry(F.concat(F.lit("a"), (k % 10).cast("string")), meta),
    )
    return t.part.select("p_partkey", metadata_hash(entries).alias("hash"))


@query(
    "t34_concatenated",
    """SELECT conv_id, count(*) AS n, string_agg(role || ':' || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS text
       FROM conversations GROUP BY conv_id""",
)
def _(t):
    line = F.concat("role", F.lit(":\n"), "text", F.lit("\n\n"))
    parts = Fr.fragments(t.conversations, ["conv_id"], ["turn"], F.floor(F.col("turn") / 512), line)
    return Fr.whole(parts, ["conv_id"]).select("conv_id", "n", F.col("value").alias("text"))


@query(
    "t35_edit_token_delta",
    f"""WITH {MSG_SQL}, tot AS (SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS total FROM msg GROUP BY conv_id)
        SELECT conv_id, msg, greatest(0, total - tokens) + {tokens_sql("replace(text, ', ', ',')")} AS new_total FROM msg JOIN tot USING (conv_id)""",
)
def _(t):
    m = t.messages()
    totals = m.groupBy("conv_id").agg(F.sum("tokens").alias("total"))
    rest = F.greatest(F.lit(0).cast("bigint"), F.col("total") - F.col("tokens"))
    edited = F.replace("text", F.lit(", "), F.lit(","))
    rows = scan.with_key_row(m, totals, ["conv_id"], F.floor(F.col("msg") / 512))
    return rows.select("conv_id", "msg", (rest + X.token_estimate(edited)).alias("new_total"))


@query(
    "t37_latest_text",
    f"""WITH {PARTS_SQL}, g AS (SELECT conv_id, turn, arg_max(x || '-' || i, i) FILTER (type = 'text' AND x <> '') AS last_part,
          string_agg(x, chr(10) ORDER BY i) FILTER (type = 'text' AND x <> '') AS all_parts FROM parts GROUP BY conv_id, turn),
        h AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN c.text ELSE coalesce(last_part, '') END AS latest,
          CASE WHEN turn % 2 = 0 THEN c.text ELSE coalesce(all_parts, '') END AS all_text FROM conversations c JOIN g USING (conv_id, turn))
        SELECT conv_id, turn, latest, all_text, turn || '__' || CASE WHEN latest = '' THEN '0' ELSE length(latest) || right(latest, 10) END
          || '__' || conv_id AS change_key FROM h""",
)
def _(t):
    text = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")
    p = F.col("parts")
    return (
        part_rows(t)
        .select(
            "conv_id", "turn", C.latest_text(text, p, with_index=True).alias("latest"), C.all_text(text, p).alias("all_text")
        )
        .withColumn(
            "change_key",
            C.change_key(F.col("turn").cast("string"), F.col("latest"), F.col("conv_id").cast("string")),
        )
    )


@query(
    "t38_payload_names",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN lower(CASE WHEN turn % 2 = 0 THEN 'User' ELSE 'Bot' END) = 'user'
         THEN 'user' ELSE 'assistant' END AS role, left(regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS name
       FROM conversations""",
)
def _(t):
    sender = F.when(F.col("turn") % 2 == 0, "User").otherwise("Bot")
    stored = F.when(F.col("turn") % 3 == 0, F.col("role"))
    return t.conversations.select(
        "conv_id",
        "turn",
        F.coalesce(stored, F.when(F.lower(sender) == "user", "user").otherwise("assistant")).alias("role"),
        C.payload_name(F.col("text")).alias("name"),
    )


@query(
    "t39_annotations",
    """SELECT doc_id, left(text, a) || '^2^' || substr(text, a + 2, b - a - 1) || '^1^' || substr(text, b + 2, c - b - 1) || '/f'
         || substr(text, c + 2) || chr(10) || chr(10) || '^1.^ ' || source || chr(10) || '^2.^ ' || lang AS text
       FROM (SELECT *, CAST(floor(length(text) * 0.25) AS BIGINT) AS a, CAST(floor(length(text) * 0.5) AS BIGINT) AS b,
         CAST(floor(length(text) * 0.75) AS BIGINT) AS c FROM documents)""",
)
def _(t):
    from convolake.operators.citations import apply_annotations

    n = F.length("text")
    place = lambda q: (F.floor(n * q).cast("int").alias("start"), (F.floor(n * q).cast("int") + 1).alias("end"))
    note = lambda kind, q, ident, file: F.struct(F.lit(kind).alias("type"), *place(q), F.lit(ident).alias("id"), file.alias("file"))
    notes = F.array(
        note("file_citation", 0.5, 1, F.col("source")),
        note("file_citation", 0.25, 2, F.col("lang")),
        note("file_path", 0.75, 3, F.lit("/f")),
    )
    rows = docs(t, "text", "source", "lang").select("doc_id", "text", notes.alias("notes"))
    # the two sources are two files whatever their names
    return apply_annotations(rows, "doc_id", by="id")


@query("t40_split_rows")
def _(t):
    return (
        part_rows(t)
        .filter("role = 'assistant'")
        .select("conv_id", "turn", F.posexplode(C.split_rows(F.col("parts"))).alias("n", "r"))
        .select("conv_id", "turn", "n", "r.*")
    )


@query(
    "t41_scaled_bytes",
    """SELECT doc_id, CASE WHEN b = 0 THEN 0 ELSE round(b / pow(1024, floor(log2(b) / 10)), 2) END AS scaled
       FROM (SELECT doc_id, n_chars * 997 AS b FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", X.scaled_bytes(F.col("n_chars") * 997).alias("scaled"))


@query(
    "s5_fingerprint",
    "SELECT doc_id, md5(text) AS fingerprint, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents",
)
def _(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("fingerprint"))
    copies = rows.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    return rows.join(copies, "fingerprint").select("doc_id", "fingerprint", "copies")
