"""The training-data operators against brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from convolake.llm import classlm, exact, html, minhash, pack, quality, substrings, suffixes, tokens, toxicity
from convolake.llm.queries import tokenizer_file

SCHEMA = "doc_id bigint, text string, count string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, odd texts; (None, ...) and a repeated row among them."""
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    rows = [(1, base), (2, base), (3, base.upper()), (4, "  " + base)]
    for i in range(5, 15):
        words = base.split()
        for at in rng.sample(range(120), 1 + i % 4):
            words[at] = sentence(rng, 1)
        rows.append((i, " ".join(words)))
    for i in range(15, 25):
        rows.append((i, sentence(rng, 40) + f" {passage}\n" + sentence(rng, 30)))
    rows += [(30, ""), (31, None), (32, " \n\t"), (33, "one two"), (34, "One two"), (35, "é" * 300), (36, "é" * 300), (None, passage), (40, "ab " * 500)]
    rows += [(41, sentence(rng, 3000)), (42, "tie tie tie tie tie tie"), (43, "tie tie  tie tie tie tie"), (25, sentence(rng, 50)), (25, sentence(rng, 50))]
    return [*rows, rows[20]]


def test_empty_tables(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for df in (
        exact.exact_groups(empty), minhash.near_duplicates(empty), substrings.dedup_substrings(empty), suffixes.dedup_suffixes(empty),
        quality.quality(empty), toxicity.toxicity(empty, labels), classlm.scores(empty, empty), pack.packed_documents(empty, tokenizer_file("byte_bpe_50k.json")),
        tokens.encoded(empty, tokenizer_file("byte_bpe_50k.tiktoken")), html.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")),
    ):
        assert df.count() == 0


def test_exact(spark, corpus):
    for hot in (1_000, 2):  # with 2, the copies take the pre-aggregated way
        got = exact.exact_groups(frame(spark, corpus), hot_least=hot, hot_texts=10**6).collect()
        groups = collections.defaultdict(list)
        for i, t in corpus:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
        assert len(got) == len(corpus)
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
        for r in got:
            assert (r.keep_id, r.group_size) == (by_hash[r.text_sha256][0][3], len(by_hash[r.text_sha256]))
        assert sum(r.kept for r in got) == len(groups)
    assert exact.drop_exact(frame(spark, corpus)).count() == len(groups)


def test_near(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = minhash.near_duplicates(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == find(r.doc_id) and r.kept == (r.doc_id == r.component_id)


def test_tokens_and_packing(spark, corpus):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    texts = [*corpus, (50, "don't  stop\n\n 12½ <|endoftext|> naïve x y  "), (51, "a" * 5000), (52, sentence(random.Random(1), 9000))]
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in texts:
        ids = plain.encode_ordinary(t or "")
        want[i, struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()] += 1
    got = collections.Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in tokens.encoded(frame(spark, texts), path).collect())
    assert got == want

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    packed = pack.packed_documents(frame(spark, texts), path).collect()
    want = collections.Counter()
    total = 0
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, (start, length) in enumerate(pack.cut_points(len(ids), 2048)):
            want[i, piece, start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= total / 2048 * 1.1 + 1


def test_strings_that_may_repeat_are_kept():
    """What is cut off the segments is single; a segment without a repeated string goes; places are those of the segment."""
    rng = random.Random(9)
    letters = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    shared = letters(20)
    segments = [letters(30) + shared + letters(25), letters(9) + shared, letters(60), b"z" * 14, b"", letters(5)]
    parts, owner, offset = suffixes.may_repeat(segments, 12, suffixes.Powers(3))
    whole = lambda rows: sorted({(segments[o][j : j + 12], o, j) for o, j in rows})
    found = [(owner[o], offset[o] + j) for _, i, at in suffixes.repeated_intervals(parts, 12) for o, j in zip(i.tolist(), at.tolist(), strict=True)]
    assert whole(found) == whole((o, j) for _, i, at in suffixes.repeated_intervals(segments, 12) for o, j in zip(i.tolist(), at.tolist(), strict=True))
    assert len(found) == 2 * 9 + 3 and sum(map(len, parts)) < sum(map(len, segments)) - 60
    assert suffixes.may_repeat([b"abc", b""], 12, suffixes.Powers(3))[0] == [] == suffixes.may_repeat([], 12, suffixes.Powers(3))[0]


def test_whole_texts_are_encoded_as_the_library_does():
    """Characters of which the pattern module takes some for letters, long runs of white space, special strings."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = tokens.TextEncoder(*tokens.merging_encoder(path))
    texts = ["\U0003f126'm", "a r\U0003f936\u628b b", "", "a \n\t b\u3000 c  ", "x <|endoftext|> y", " " * 1_200_000 + "a", "ab c\n " * 50_000]
    for text, ids in zip(texts, encoder(texts), strict=True):
        parts = text.split("<|endoftext|>")  # special strings are ids of their own
        want = [i for n, part in enumerate(parts) for i in ([50256] if n else []) + library.encode(part, add_special_tokens=False).ids]
        assert ids == tokens.packed(want)


def test_packing_tree(spark):
    rng = random.Random(2)
    pieces = spark.createDataFrame([(rng.randint(1, 100),) for _ in range(2000)], "length int")
    rows = pack.pack(pieces, capacity=100, node_items=50, fan_in=3).collect()
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and sum(n for _, n in parts) <= 100
    assert len(rows) == 2000 and len(used) <= 1.08 * sum(r.length for r in rows) / 100


def test_substrings(spark, corpus):
    words = [(i, (t or "").encode().split()) for i, t in corpus]
    times = collections.Counter(tuple(w[j : j + 35]) for _, w in words for j in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = set()
        for j in range(len(w) - 34):
            if times[tuple(w[j : j + 35])] > 1:
                gone.update(range(j, j + 35))
        want[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    assert collections.Counter(map(tuple, substrings.dedup_substrings(frame(spark, corpus)).collect())) == want


def test_anchor_groups():
    segments = sorted((a, bytes([65 + i]) * (3 + i), (("n", i), a)) for a in range(6) for i in range(a + 1))
    groups = list(suffixes.anchor_groups(segments, 10))
    assert [(p, s) for g in groups for p, s in g] == [(p, s) for _, s, p in segments] and len(groups) > 3
    assert all(not {p[1] for p, _ in g} & {p[1] for p, _ in h} for i, g in enumerate(groups) for h in groups[:i])
    assert list(suffixes.anchor_groups([])) == []


def test_suffixes(spark, corpus):
    first = {}
    data = [(i, (t or "").encode()) for i, t in corpus]
    order = [(suffixes.NO_ID if i is None else i, b) for i, b in data]
    for i, b in order:
        for j in range(len(b) - 99):
            s = b[j : j + 100]
            first[s] = min(first.get(s, (i, j)), (i, j))
    want = collections.Counter()
    for (i, b), (name, _) in zip(order, data, strict=True):
        gone = set()
        for j in range(len(b) - 99):
            if first[b[j : j + 100]] < (i, j):
                gone.update(range(j, j + 100))
        spans = sum(j - 1 not in gone for j in gone)
        want[name, len(b), spans, bytes(x for j, x in enumerate(b) if j not in gone)] += 1
    got = suffixes.dedup_suffixes(frame(spark, corpus)).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_spans, bytes(r.kept)) for r in got) == want


def test_interleaving_equals_sorting():
    rng = random.Random(3)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 40))).encode() for _ in range(30)]
    for depth in (4, 9):
        times = collections.Counter(s[j : j + depth] for s in segments for j in range(len(s) - depth + 1))
        got = set()
        for interval, owner, offset in suffixes.repeated_intervals(segments, depth, shard_bytes=90):
            assert len(interval) == len(owner) == len(offset)
            got |= set(zip(owner.tolist(), offset.tolist(), strict=True))
        assert got == {(i, j) for i, s in enumerate(segments) for j in range(len(s) - depth + 1) if times[s[j : j + depth]] > 1}


def test_intervals_of_few_segments():
    shared = bytes(range(97, 109))
    for n1, n2 in ((3, 9), (5, 5), (9, 3)):  # shorter than, as long as and longer than the last segment
        two = [shared + b"A" * n1, shared + b"B" * n2]
        for segments in (two, [b"C" * 11, *two], [*two, b"C" * 60]):
            found = {(segments[o][j : j + 12], o) for _, owner, offset in suffixes.repeated_intervals(segments, 12) for o, j in zip(owner.tolist(), offset.tolist(), strict=True)}
            assert {o for s, o in found if s == shared} == {i for i, s in enumerate(segments) if s.startswith(shared)}
    assert list(suffixes.repeated_intervals([shared], 12)) == []


def test_prefix_of_two_documents(spark):
    for seed in range(6):
        rng = random.Random(seed)
        prefix = sentence(rng, 60)
        rows = [(1, prefix + "Y" + sentence(rng, 30)), (2, prefix + "Z" + sentence(rng, 30))]
        kept = {r.doc_id: bytes(r.kept).decode() for r in suffixes.dedup_suffixes(frame(spark, rows)).collect()}
        assert kept == {1: rows[0][1], 2: rows[1][1][len(prefix) :]}


def test_quality(spark, corpus):
    rows = quality.quality(frame(spark, corpus)).collect()
    assert len(rows) == len(corpus)
    texts = collections.defaultdict(list)
    for i, t in corpus:
        texts[i].append(t or "")
    for r in rows:
        found = set()
        for t in texts[r.doc_id]:
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            times = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            covered = {k for j in range(len(w) - 2) if times[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            found.add((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in found


def test_quality_finds_faults(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 150)) for i in range(200)]
    rows += [(i, " ".join(w + "%%%" for w in sentence(rng, 150).split())) for i in range(200, 215)]
    rows += [(i, "same words again " * 60) for i in range(215, 230)]
    kept = {r.doc_id for r in quality.quality(frame(spark, rows)).filter("good").collect()}
    assert kept == set(range(200))


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [(900, None), (901, ""), (None, "zorkel")], []
    for i in range(300):
        t = sentence(rng, 40)
        if i % 5 == 0:
            t += " zorkel " + sentence(rng, 5)
        rows.append((i, t))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, "abc z0rk3l def"), (1001, "abc z o r k e l def"), (1002, "abc zorrrkel def"), (1003, "clean words here")]
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, rows), table).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(300))
    assert min(got[1000], got[1001], got[1002]) >= 0.7 and max(got[1003], got[900], got[901]) < 0.7 and got[900] == got[901]


def test_disguises():
    rng = random.Random(8)
    text = "\n".join(sentence(rng, 8) + " such a moron and an idiot or a stupid fool " for _ in range(300))
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    codes = [toxicity._SYMBOL.get(c, 0) for c in text]
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        counts[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    restorer = toxicity.Restorer(counts)
    for text, word in (
        ("you iddiot", "idiot"), ("a moroon here", "moron"), ("so stuupid", "stupid"), ("m 0 r 0 n", "moron"), ("1 d 1 o t", "idiot"),
        ("m  o  r  o  n", "moron"), ("m . o . r . o . n", "moron"), ("such a m o r o n", "moron"), ("i d i o t s t u p i d", "stupid"),
        ("i d i o t s t u p i d", "idiot"), ("m" + "o" * 60 + "ron", "moron"), ("fo" + "o" * 45 + "l", "fool"), ("a m-o-r-o-n!", "moron"),
        ("m0r0n", "moron"), ("m.o.r.o.n", "moron"),
    ):
        assert word in restorer.words(text), (text, restorer.words(text))
    assert restorer.words("we a b") == {"we", "a", "b"} and "moron" in restorer.words("(m o r o n) 1 2 3")


def test_class_model(spark, corpus):
    train = [r for r in corpus if r[0] is not None and r[0] % 3]
    counts, ends = collections.Counter(), 0
    for _, t in train:
        counts.update((t or "").encode().lower().split())
        ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for vocabulary in (10_000, 60):
        rows = classlm.scores(frame(spark, corpus), frame(spark, train), core=20, classes=5, vocabulary=vocabulary).collect()
        want = collections.Counter()
        for i, t in corpus:
            w = (t or "").encode().lower().split()
            base = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
            want[i, len(w) + 1, sum(x in counts for x in w) + 1, n, round(float(base), 4)] += 1
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><div>menu one</div><div>menu two</div>{}<div>end</div></body></html>"
    rows = [(i, "http://h.example/x", page.format(f"<div>own {i} &amp; <b>te</b>xt<p>more {i}</div>")) for i in range(6)]
    rows += [(10, None, None), (11, "http://o.example", ""), (12, "http://o.example", "<nav>n</nav><article><h1>A</h1><p>b<br>c<script>x</p></script></article><footer>f")]
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        want = f"own {i} & text more {i}"
        assert got[i] == (want, len(want))
    assert got[10] == got[11] == ("", 0) and got[12] == ("A b c", 5)


def test_html_template_inside_articles(spark):
    page = "<body><div>menu</div><article><h1>title {0}</h1><div>text {0}</div>{1}</article><div>own {0}</div></body>"
    rows = [(i, "http://a.example/x", page.format(i, "<div>buy now</div>" if i else "")) for i in range(8)]
    plain = page.replace("article", "section")
    rows += [(100 + i, "http://b.example/x", (page if i < 7 else plain).format(i, "<p>as ever</p>")) for i in range(10)]
    rows += [(200 + i, "http://c.example/x", page.format(1, "")) for i in range(5)]  # copies of one page are no template
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"title {i} text {i}"
    for i in range(7):
        assert got[100 + i] == f"title {i} text {i}"
    assert all("as ever" not in got[100 + i] and "menu" not in got[100 + i] for i in range(7))
    assert all(got[200 + i] == "title 1 text 1" for i in range(5))


def test_html_classes_are_ordered_and_nested():
    classes = {1: 7, 2: 7, 3: 8, 4: 8}
    assert page_of([1, 3, 4, 2], classes) == ({7: {(0, 0)}, 8: {(7, 1)}}, set())
    assert page_of([1, 3, 2, 4], classes)[1] == {8}
    assert html.page_order([1, 2, 2, 1], classes) == {} and html.page_order([1, 2, 1, 2], classes) == {7: (1, 2)}


def page_of(tokens, classes):
    return html.page_slots(tokens, classes, html.page_order(tokens, classes))[1:]


def test_html_class_names():
    def text(page):
        return " ".join(t for _, t, chrome, _ in html.Blocks().blocks(page) if t and not chrome)

    for page in (
        '<body class="no-sidebar"><p>a</p>', '<body class="sidebar"><p>a</p>', '<div class="content has-sidebar"><p>a</p></div>',
        '<main id="content-header-fixed">a</main>', '<div class="sidebar"><b>x</b><article>a</article></div>', '<article class="related">a</article>',
        '<article>a</article><div class="wide related"><article>t</article></div>', '<p>a</p><div class="ad">x</div><nav>y</nav>',
    ):
        assert text(page).removeprefix("x ") == "a", page


def test_pipeline(spark):
    import corpus_pipeline
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == before
