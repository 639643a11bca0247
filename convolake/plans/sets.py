"""Set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions.text import jaccard, word_set
from convolake.operators import sets as S
from convolake.operators.dedup import keep_first_similar
from convolake.plans.registry import query
from convolake.session import spread


def _tags(*values):
    return F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values])


_TAGS = """tags AS (SELECT conv_id, turn, ['r:' || role, 't' || turn % 3, 'n' || conv_id % 4] AS old,
  ['r:' || role, 't' || (turn + 1) % 3, 'new'] AS new FROM conversations)"""


def tags(t):
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    turn, conv, role = F.col("turn"), F.col("conv_id"), F.concat(F.lit("r:"), F.col("role"))
    return t.conversations.select(
        "conv_id",
        "turn",
        F.array(role, s("t", turn % 3), s("n", conv % 4)).alias("old"),
        F.array(role, s("t", (turn + 1) % 3), F.lit("new")).alias("new"),
    )


@query(
    "u2_tag_changes",
    f"""WITH {_TAGS} SELECT conv_id, turn, array_to_string(list_filter(new, lambda x: NOT list_contains(old, x)), ',') AS added,
        array_to_string(list_filter(old, lambda x: NOT list_contains(new, x)), ',') AS removed FROM tags""",
)
def _(t):
    added, removed = S.set_changes(F.col("old"), F.col("new"))
    return tags(t).select(
        "conv_id", "turn", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed")
    )


@query(
    "u3_array_edits",
    f"""WITH {_TAGS} SELECT conv_id, turn,
          array_to_string(list_sort(list_distinct(list_concat(old, new))), ',') AS united,
          array_to_string(list_filter(old, lambda x: x <> 't1'), ',') AS pulled,
          array_to_string(list_transform(old, lambda x: CASE WHEN x = 't1' THEN 'renamed' ELSE x END), ',') AS renamed
        FROM tags""",
)
def _(t):
    old, new = F.col("old"), F.col("new")
    return tags(t).select(
        "conv_id",
        "turn",
        F.array_join(F.array_sort(S.add_to_set(old, new)), ",").alias("united"),
        F.array_join(S.pull(old, F.lit("t1")), ",").alias("pulled"),
        F.array_join(S.rename_element(old, F.lit("t1"), F.lit("renamed")), ",").alias("renamed"),
    )


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-zA-Z0-9_\s]', '', 'g'), '\s+'), lambda w: length(w) > 2))"


@query(
    "u4_jaccard",
    f"""WITH s AS (SELECT source, lang, doc_id, {_WORDS.format('text')} AS words,
          lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS next_id FROM documents)
        SELECT a.doc_id, a.next_id, round(CASE WHEN len(list_distinct(list_concat(a.words, b.words))) > 0 THEN
          len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) ELSE 0 END, 6) AS similarity
        FROM s a JOIN s b ON b.doc_id = a.next_id""",
)
def _(t):
    from convolake.operators.scan import with_previous

    # each text against the next one of its source and language
    docs = spread(t.documents.select("doc_id", "source", "lang", "text")).select(
        "doc_id", "source", "lang", word_set(F.col("text")).alias("words")
    )
    pairs = with_previous(
        docs.select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], F.floor(F.col("doc_id") / 100000),
        {"before": "doc_id"},
    ).filter("before IS NOT NULL")
    words = docs.select("doc_id", "words")
    return (
        pairs.select("before", "doc_id")
        .join(words, "doc_id")
        .join(words.select(F.col("doc_id").alias("before"), F.col("words").alias("first_words")), "before")
        .select(
            F.col("before").alias("doc_id"),
            F.col("doc_id").alias("next_id"),
            F.round(jaccard(F.col("first_words"), F.col("words")), 6).alias("similarity"),
        )
    )


@query(
    "u5_keep_first_similar",
    f"""WITH RECURSIVE w AS (SELECT source, doc_id, {_WORDS.format('text')} AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
          FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 20),
        p AS (SELECT b.source, b.doc_id, list(a.doc_id) AS near FROM w a JOIN w b ON a.source = b.source AND a.rn < b.rn
          WHERE len(b.words) > 0 AND len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) >= 0.7 GROUP BY ALL),
        g(source, rn, kept) AS (SELECT DISTINCT source, 0::BIGINT, []::BIGINT[] FROM w
          UNION ALL SELECT g.source, w.rn, CASE WHEN near IS NULL OR NOT list_has_any(near, kept) THEN list_append(kept, w.doc_id) ELSE kept END
          FROM g JOIN w ON w.source = g.source AND w.rn = g.rn + 1 LEFT JOIN p ON p.source = w.source AND p.doc_id = w.doc_id)
        SELECT source, unnest(kept) AS doc_id FROM (SELECT source, arg_max(kept, rn) AS kept FROM g GROUP BY source)
        UNION SELECT source, min(doc_id) FROM documents GROUP BY source HAVING count(*) = 1""",
)
def _(t):
    return keep_first_similar(spread(t.documents.select("doc_id", "source", "text")), "source", "doc_id", "text")


@query(
    "u6_member_and_owner",
    """SELECT DISTINCT s_nationkey AS grp, s_suppkey AS member FROM supplier
       UNION SELECT c_nationkey, c_custkey FROM customer WHERE c_acctbal > 9000""",
)
def _(t):
    owners = t.supplier.select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("member"))
    members = t.customer.filter("c_acctbal > 9000").select(
        F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("member")
    )
    return owners.union(members).distinct()


@query(
    "u7_same_members",
    """SELECT l_orderkey, l_linenumber, l_partkey, list_sort([l_suppkey % 3, l_linenumber % 3, 1]) =
         list_sort([l_linenumber % 3, l_partkey % 3, 1]) AS same FROM lineitem""",
)
def _(t):
    s, n, p = F.col("l_suppkey") % 3, (F.col("l_linenumber") % 3).cast("bigint"), F.col("l_partkey") % 3
    one = F.lit(1).cast("bigint")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", S.same_members(F.array(s, n, one), F.array(n, p, one)).alias("same")
    )


@query(
    "u8_rename_collisions",
    """SELECT p_partkey, p_brand AS owner, replace(p_name, 'ring', 'widget') AS new_tag FROM part p
       WHERE contains(p_name, 'ring') AND EXISTS (
         SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_name = replace(p.p_name, 'ring', 'widget'))""",
)
def _(t):
    renames = t.part.filter(F.col("p_name").contains("ring")).select(
        "p_partkey", F.col("p_brand").alias("owner"), F.replace("p_name", F.lit("ring"), F.lit("widget")).alias("new_tag")
    )
    taken = t.part.select(F.col("p_brand").alias("owner"), F.col("p_name").alias("new_tag"))
    return renames.join(taken, ["owner", "new_tag"], "left_semi").select("p_partkey", "owner", "new_tag")


@query(
    "u9_visibility_sets",
    """WITH acc AS (SELECT DISTINCT o_custkey AS id FROM orders), pub AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 8000)
       SELECT 'mine' AS listing, id FROM (SELECT id FROM acc EXCEPT SELECT id FROM pub)
       UNION ALL SELECT 'shared', id FROM (SELECT id FROM pub INTERSECT SELECT id FROM acc)
       UNION ALL SELECT 'all', id FROM (SELECT id FROM acc UNION ALL SELECT id FROM pub)""",
)
def _(t):
    accessible = t.orders.select(F.col("o_custkey").alias("id")).distinct()
    public = t.customer.filter("c_acctbal > 8000").select(F.col("c_custkey").alias("id"))
    tag = lambda df, name: df.select(F.lit(name).alias("listing"), "id")
    return (
        tag(accessible.join(public, "id", "left_anti"), "mine")
        .unionByName(tag(public.join(accessible, "id", "left_semi"), "shared"))
        .unionByName(tag(accessible.unionByName(public), "all"))
    )


@query(
    "u10_keep_first",
    """SELECT md5(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE lang = 'en' GROUP BY 1
       UNION ALL SELECT md5(text), doc_id, source FROM documents WHERE doc_id IN (
         SELECT doc_id FROM labels WHERE toxic = 1) AND lang <> 'en'""",
)
def _(t):
    docs = t.documents.select(F.md5("text").alias("key"), "doc_id", "source", "lang")
    given = S.keep_first(docs.filter("lang = 'en'").drop("lang"), "key", "doc_id")
    english = docs.filter("lang = 'en'").select("doc_id")
    wanted = t.labels.filter("toxic = 1").select("doc_id").join(english, "doc_id", "left_anti")
    return S.union_missing(given, wanted, docs.drop("lang"), "doc_id")


@query(
    "w13_suppress_repeats",
    """SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) AS rn
       FROM documents) WHERE rn = 1""",
)
def _(t):
    rows = t.documents.select(F.concat_ws("/", "lang", "n_chars").alias("key"), "doc_id", "source", "n_chars")
    return S.keep_first(rows, "key", "doc_id").drop("key")
