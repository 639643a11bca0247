"""Pages whose markup leaves things out or names them oddly, on hosts without a template."""

import random

import pytest

from convolake.llm import html

STORY = "the story of the page goes on and on for a while"
CASES = {
    "head without end tag": f"<html><head><title>t</title><body><p>{STORY}</p></body></html>",
    "text ends the head": f"<head><title>t</title>{STORY}",
    "only comments are articles": f'<body><div>{STORY}</div><article class="comment">c1</article><article class="comment-item">c2</article>',
    "comment in main": f'<main><p>{STORY}</p><article class="comment">c1</article></main>',
    "article in an article": f"<article>{STORY}<article>reply</article></article>",
    "parts of class names": f'<article>{STORY}<div class="ad-slot">buy</div><section class="post-comments">hey</section></article><div class="site-footer">f</div>',
    "a part names the page": f'<div class="content has-sidebar"><p>{STORY}</p></div>',
    "a part names the element around": f'<div id="page-header-fixed"><article>{STORY}</article></div>',
    "no markup": STORY,
    "white space": f"<p>\n\t{STORY.replace(' ', '  ')}&#32;</p>",
    "references": f"<p>{STORY.replace('story', 's&#116;ory')}</p>",
}


def texts(spark, rows, shape="page_id bigint, url string, html string"):
    return [tuple(r) for r in html.main_text(spark.createDataFrame(rows, shape)).collect()]


def test_pages(spark):
    rows = [(i, f"http://h{i}/", page) for i, page in enumerate(CASES.values())]
    got = {r[0]: r[2] for r in texts(spark, rows)}
    assert {name: got[i] for i, name in enumerate(CASES)} == dict.fromkeys(CASES, STORY)


def test_odd_rows(spark):
    """Null ids and urls, repeated rows, clashing columns, a very long page."""
    long = "<p>" + "word " * 300_000 + "</p>"
    rows = [(None, None, "<p>a</p>"), (1, None, None), (1, "u", ""), (2, "http://x/", long), (3, "http://y/", "<p>b</p>"), (3, "http://y/", "<p>b</p>")]
    shape = "page_id bigint, url string, html string, host string, blocks string, text string, slots string"
    got = sorted(texts(spark, [(*r, "h", "b", "t", "s") for r in rows], shape), key=repr)
    want = [(None, None, "a", 1), (1, None, "", 0), (1, "u", "", 0), (2, "http://x/", ("word " * 300_000).strip(), 1_499_999), (3, "http://y/", "b", 1), (3, "http://y/", "b", 1)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("marked", [True, False])
def test_template_decides(spark, marked):
    """A repeated block without any telling name, inside the article: only the other pages of the host give it away."""
    rng = random.Random(8)
    story = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    open_, close = ("<article>", "</article>") if marked else ("<section>", "</section>")
    rows, want = [], {}
    for i in range(12):
        first, second = story(), story()
        page = f"<body><div>Town Gazette</div>{open_}<p>{first}</p><div>Order the printed edition today</div><p>{second}</p>{close}<div>All rights kept</div></body>"
        rows.append((i, "http://gazette.example/a", page))
        want[i] = f"{first} {second}"
    rows.append((99, "http://other.example/a", rows[0][2]))  # alone on its host: nothing repeats
    got = {r[0]: r[2] for r in texts(spark, rows)}
    assert {i: got[i] for i in want} == want
    assert "printed edition" in got[99]
