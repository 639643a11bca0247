"""Callers' tokenizers, chunkers and page extractors."""

import pytest
from conftest import DATA

from convolake.functions import tokenizers as K
from convolake.operators import hooks as H
from convolake.plans import ENTRIES


def test_arrow_tokenizer_keeps_nulls(spark):
    letters = K.arrow_tokenizer(lambda: lambda texts: [len(t) for t in texts])
    df = spark.createDataFrame([("ab", ["a", None, "bc"]), (None, None), ("", [])], "t string, a array<string>")
    got = df.select(letters.count("t").alias("n"), letters.total("a").alias("m"), K.ESTIMATE.total("a").alias("e")).collect()
    assert [tuple(r) for r in got] == [(2, 3, 4), (None, None, None), (0, 0, 0)]


def test_byte_pair_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = lambda text: len(plain.encode_ordinary(text))
    texts = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    context = {(r.conv_id, r.msg): r.tokens for r in ENTRIES["x2_context_bpe"].run(spark, DATA).collect()}
    assert context == {k: count(r.text) for k, r in texts.items()}
    want = {}
    for key, r in texts.items():
        n = 3 + count(r.role)
        for i, x in enumerate(r.text.split("\n")):
            values = [x] if i % 4 == 0 else ["search", x, x.replace("a", "b")] if i % 4 == 2 else []
            n += sum(count(v) for v in values if v)
        want[key] = n
    assert {(r.conv_id, r.turn): r.tokens for r in ENTRIES["x2_message_tokens_bpe"].run(spark, DATA).collect()} == want
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {}
    for r in ENTRIES["x3_chunk_function_bpe"].run(spark, DATA).collect():
        assert r.tokens == count(r.content)
        found.setdefault(r.doc_id, []).append((r.chunk_index, r.content))
    want = {i: [c.strip() for c in H.sentence_chunks(t or "", lambda ts: [count(x) for x in ts])] for i, t in docs.items()}
    assert {i: [c for _, c in sorted(v)] for i, v in found.items()} == {i: [c for c in v if c] for i, v in want.items() if any(v)}


def test_own_chunker(spark):
    words = H.chunker(split=lambda text, counts: text.split(" "))
    df = spark.createDataFrame([(1, "a b  c"), (2, None), (3, "")], "id int, text string")
    got = sorted(map(tuple, H.chunk_rows(df, "text", words).collect()))
    assert got == [(1, 0, "a", 2), (1, 1, "b", 2), (1, 2, "c", 2)]
    H.register_chunker(spark, "words_of", words)
    df.createOrReplaceTempView("texts_of_test")
    assert spark.sql("SELECT id, content FROM texts_of_test, LATERAL words_of(text)").count() == 3


def test_long_sentence_and_tail():
    counts = lambda texts: [len(t.split(" ")) for t in texts]
    got = list(H.sentence_chunks("a b c. d e f g h i j. k l. m n o", counts, size=5, overlap=2))
    assert got == ["a b c", "d e f g h", "i j", "k l m n o"]
    got = list(H.sentence_chunks("a b c d. e f g", counts, size=5, overlap=2))
    assert got == ["a b c d", "c d e f g"]


def test_tail_reads_a_long_text_once():
    pytest.importorskip("tiktoken")
    import random

    P = pytest.importorskip("public_tokenizers")
    load = K.byte_pairs(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).load
    rng = random.Random(4)
    parts = ["a", "word", "It's", "12345", "\u00e9t\u00e9", "  ", "\t", "\n x", "...", "\U0001f600", "antidisestablishment", "'", ""]
    texts = [" ".join(rng.choice(parts) for _ in range(400)) for _ in range(30)] + ["a" * 900, "x ", " x" * 300, " " * 50 + "b"]
    plain, counts = load(), load()
    for text in texts:
        for overlap in (0, 1, 7, 100):
            assert H._tail(text, counts, overlap) == H._tail(text, lambda ts: plain(ts), overlap)  # noqa: PLW0108
    seen = 0
    whole = type(counts).__call__

    class Counted(type(counts)):
        def __call__(self, texts):
            nonlocal seen
            seen += sum(map(len, texts))
            return whole(self, texts)

    counts.__class__ = Counted
    text = "one two three four " * 300
    H._tail(text, counts, 1000)
    assert seen <= 2 * len(text)


def test_pages(spark):
    def extractor(path, content):
        for part in content.decode().split("|"):
            if part == "bad":
                raise OSError("broken page")
            yield part

    rows = [("a", b"1|2|3"), ("b", b"1|bad|3"), ("c", b"\xff"), ("d", None), ("e", b"|".join([b"x" * 1000] * 2000)), ("f", b"")]
    files = spark.createDataFrame([(p, c, "z") for p, c in rows], "path string, content binary, page string")
    got = sorted(map(tuple, H.extract_pages(files, extractor, rows=100, size=50_000).collect()), key=repr)
    assert [r for r in got if r[0] == "a"] == [("a", i, str(i), None) for i in (1, 2, 3)]
    assert sorted((r for r in got if r[0] == "b"), key=repr) == [("b", 1, "1", None), ("b", None, None, "OSError: broken page")]
    assert [r[1:3] for r in got if r[0] in "cd"] == [(None, None)] * 2 and all(r[3] for r in got if r[0] in "cd")
    assert sorted(r[1] for r in got if r[0] == "e") == list(range(1, 2001))
    assert [r for r in got if r[0] == "f"] == [("f", 1, "", None)]
    assert H.extract_pages(files.limit(0), extractor).count() == 0
