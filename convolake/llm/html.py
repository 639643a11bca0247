"""Main text of web pages by template deduction over the pages of a host.

A token is a start or end tag, or a block of text, together with the tags it stands under. Tokens of a host with the same
occurrence vector (as often on each of its pages) form an equivalence class. The vectors are compared by a hash sum over
pages, so that none is gathered anywhere. A class is valid if its tokens are on most pages of the host, follow each other
in one order everywhere and stand in one slot of the class around them; a token on nearly all pages is valid by itself.
Valid classes are the template: text blocks in them are boilerplate, whatever is marked. What fills the remaining slots is
kept unless its element never holds an article; the page's article mark, or without one the slots that other pages of the
host mark, tell which slots are the article's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import text_key, written
from convolake.session import broadcast_if_small

LEAST_PAGES = 4  # pages a host must have before repeated blocks count as template
SHARE = 0.6  # of a host's pages that a template token is on
LEAST_TOKENS = 2  # tokens of a valid class
LONE_SHARE = 0.8  # of a host's pages that a token is on which is template by itself
HANDED_HOSTS = 5_000  # templates that every task gets; more of them meet their pages in a join by host

# Element and attribute names of HTML.
INVISIBLE = frozenset("script style template noscript head title iframe object svg canvas math audio video select datalist".split())
CHROME = frozenset("nav header footer aside form button menu dialog input textarea label fieldset".split())
ARTICLE = frozenset("article main".split())
HOLDERS = ARTICLE | {"html", "body"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr del ins big strike".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsored sponsor sidebar menu navbar navigation nav footer "
    "header breadcrumb breadcrumbs cookie cookies consent notice popup modal newsletter subscribe share social related "
    "comment comments reply replies disqus widget toolbar masthead pagination pager copyright".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies".split())
IN_HEAD = frozenset("title base link meta style script noscript template".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
AUTO_CLOSE = {
    "p": frozenset(
        "p div ul ol li dl table h1 h2 h3 h4 h5 h6 section article main aside nav header footer form pre blockquote hr address figure details fieldset".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option"]),
}


LEAST_OF_PAGE = 4  # an element named by a part of a class name is boilerplate if it has at most 1 / LEAST_OF_PAGE of the page's text


def class_names(attributes: list[tuple[str, str | None]]) -> set[str]:
    return {n for name, value in attributes if name in ("class", "id") and value for n in value.lower().split()}


def is_named(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a whole class name or id is a word for boilerplate; only a hint, and none on elements that hold a page or its article."""
    return tag not in HOLDERS and bool(CHROME_WORDS & class_names(attributes))


def is_partly_named(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a part of a class name or id (``site-footer``) is one; a weaker hint."""
    return tag not in HOLDERS and any(CHROME_WORDS.intersection(re.split("[-_]+", n)) for n in class_names(attributes))


def is_chrome(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    if tag in CHROME:
        return True
    if tag == "article" and any(COMMENT_WORDS.intersection(re.split("[-_]+", n)) for n in class_names(attributes)):
        return True
    for name, value in attributes:
        if name == "role" and value and value.lower() in CHROME_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


@lru_cache(maxsize=100_000)
def kind(tag: str, attributes: tuple[tuple[str, str | None], ...]) -> tuple[bool, bool, bool]:
    """(chrome, named, named by a part); the same few start tags open most elements."""
    return is_chrome(tag, attributes), is_named(tag, attributes), is_partly_named(tag, attributes)


class Blocks(HTMLParser):
    """Blocks and tags of a page: (path of tags, text, in boilerplate, in an article); tags have a null text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, bool, bool, tuple]] = []
        # tag, chrome, invisible, article, named elements around, path of tags
        self.stack: list[tuple[str, bool, bool, bool, tuple, str]] = [("", False, False, False, (), "")]
        self.words: list[str] = []
        self.named = 0
        self.around: set[int] = set()  # named elements around an article
        self.weak: dict[int, int] = {}  # elements named by a part of a class name, with the length of their text
        self.length = 0
        self.free_article = False  # an article that no named element is around

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            _, chrome, invisible, article, named, path = self.stack[-1]
            if not invisible:
                self.found.append((path, text, chrome, article, named))
                self.length += len(text)
                for n in named:
                    if n in self.weak:
                        self.weak[n] += len(text)

    def tag(self, sign: str) -> None:
        tag, chrome, invisible, article, named, path = self.stack[-1]
        if tag not in INLINE and not invisible:
            self.found.append((path + sign, None, chrome, article, named))

    def close_from(self, i: int) -> None:
        while len(self.stack) > i:
            self.tag(">")
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.handle_endtag("head")  # its end tag may be left out
        top = self.stack[-1]
        if tag == "br":
            self.words.append(" ")
            return
        is_boilerplate, whole_name, part_name = kind(tag, tuple(attrs))
        if tag in INLINE:
            if not is_boilerplate and not whole_name:
                if tag not in VOID:
                    self.stack.append((tag, *top[1:]))
                return
        self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if tag in AUTO_CLOSE.get(name, ()):
                self.close_from(i)
                break
            if name not in INLINE and name not in AUTO_CLOSE:
                break
        if tag in VOID:
            return
        _, chrome, invisible, article, named, path = self.stack[-1]
        inner = tag == "article" and any(t[0] == "article" for t in self.stack)  # an article in an article is a comment on it
        chrome, invisible = chrome or inner or is_boilerplate, invisible or tag in INVISIBLE
        if part_name:
            self.named += 1
            named = (*named, self.named)
            if not whole_name:
                self.weak[self.named] = 0
        if tag in ARTICLE and not chrome and not invisible:
            self.around.update(named)
            self.free_article |= not named
        self.stack.append((tag, chrome, invisible, article or tag in ARTICLE, named, path if tag in INLINE else f"{path}/{tag}"))
        self.tag("<")

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if tag not in INLINE or any(t not in INLINE for t, *_ in self.stack[i:]):
                    self.flush()
                self.close_from(i)
                return

    def handle_data(self, data):
        if self.stack[-1][0] == "head" and data.strip():
            self.handle_endtag("head")
        self.words.append(data)

    def blocks(self, page: str) -> list[tuple[str, str, bool, bool]]:
        self.feed(page)
        self.close()
        self.flush()
        self.close_from(1)
        kept = set() if self.free_article else set(self.around)  # the page's article is in them
        kept |= {n for n, length in self.weak.items() if LEAST_OF_PAGE * length > self.length}
        kept |= self.around & set(self.weak)
        return [(path, text, chrome or any(n not in kept for n in named), article) for path, text, chrome, article, named in self.found]


def page_blocks(pages: DataFrame) -> DataFrame:
    """A row per page with its host and its tokens in order; tags and boilerplate have a null text, pages without tokens an empty list."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^\w+://([^/:?#]+)", 1))
    rows = pages.select("page_id", "url", text_key(html).alias("content"), host.alias("host"), html.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns, ends = ([], [], [], []), [0]
                for page in part.column(4):
                    for path, text, chrome, article in Blocks().blocks(page.as_py()):
                        token = xxhash.xxh64_intdigest(f"{path}\n{text or ''}") - 2**63
                        for column, value in zip(columns, (token, None if chrome else text, chrome, article), strict=True):
                            column.append(value)
                    ends.append(len(columns[0]))
                kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_())
                tokens = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["token", "text", "chrome", "article"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], names=["page_id", "url", "content", "host", "blocks"])

    page = pages.schema["page_id"].dataType.simpleString()
    block = "struct<token: bigint, text: string, chrome: boolean, article: boolean>"
    return rows.mapInArrow(run, f"page_id {page}, url string, content bigint, host string, blocks array<{block}>")


def page_order(tokens: list[int], classes: dict[int, int]) -> dict[int, tuple[int, ...]]:
    """The tokens of each class in their order, of classes that repeat one order on this page."""
    runs: dict[int, list[int]] = {}
    for t in tokens:
        if t in classes:
            runs.setdefault(classes[t], []).append(t)
    found = {}
    for c, run in runs.items():
        order = tuple(dict.fromkeys(run))
        if run == [*order] * (len(run) // len(order)):
            found[c] = order
    return found


def page_slots(tokens: list[int], classes: dict[int, int], orders: dict[int, tuple[int, ...]]) -> tuple[list[tuple[int, int]], dict[int, set], set[int]]:
    """The slot (class, how many of its tokens are past) of each token, the slots each class opens in, the classes that cross others."""
    open_, slots, places, crossing = [(0, 0)], [], {}, set()
    for t in tokens:
        c = classes.get(t)
        if c in orders and c not in crossing:
            if len(orders[c]) == 1:
                places.setdefault(c, set()).add(open_[-1])
            elif t == orders[c][0]:
                places.setdefault(c, set()).add(open_[-1])
                open_.append((c, 1))
            else:
                while len(open_) > 1 and open_[-1][0] != c:  # opened since and not ended
                    crossing.add(open_.pop()[0])
                if len(open_) > 1:
                    n = open_.pop()[1] + 1
                    if n < len(orders[c]):
                        open_.append((c, n))
        slots.append(open_[-1])
    return slots, places, crossing


def candidate_classes(blocks: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, token, class, lone): tokens on most of a host's different pages and their equivalence classes; lone ones need no class."""
    sizes = blocks.groupBy("host").agg(F.countDistinct("content").alias("pages")).filter(F.col("pages") >= least_pages)
    sizes = broadcast_if_small(sizes)
    each = blocks.join(sizes, "host", "left_semi").select("host", "content", F.explode(F.transform("blocks", lambda b: b["token"])).alias("token"))
    on_page = each.groupBy("host", "content", "token").agg(F.count("*").alias("times"))
    vectors = on_page.groupBy("host", "token").agg(
        F.count("*").alias("support"),
        F.sum(F.xxhash64("content", "times").cast("decimal(38,0)")).alias("vector"),
    )
    frequent = vectors.join(sizes, "host").filter(F.col("support") >= share * F.col("pages")).withColumn("class", F.xxhash64("vector"))
    groups = frequent.groupBy("host", "class").agg(F.count("*").alias("tokens"))
    lone = F.col("support") >= LONE_SHARE * F.col("pages")
    return frequent.join(groups, ["host", "class"]).filter(lone | (F.col("tokens") >= LEAST_TOKENS)).select("host", "token", "class", lone.alias("lone"))


def by_host(classes: DataFrame) -> DataFrame:
    """(host, classes): bounded by the tokens of one page, as each token is on most pages of its host."""
    return classes.groupBy("host").agg(F.collect_list(F.struct("token", "class", "lone")).alias("classes"))


def valid_classes(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates, those whose class has no single order or place without their class (0) and only if lone."""
    rows = blocks.select("host", F.transform("blocks", lambda b: b["token"]).alias("tokens")).join(broadcast_if_small(by_host(candidates), HANDED_HOSTS), "host")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = set()
            for host, tokens, found in zip(frame["host"], frame["tokens"], frame["classes"], strict=True):
                tokens, classes = list(tokens), {x["token"]: x["class"] for x in found}
                orders = page_order(tokens, classes)
                _, places, crossing = page_slots(tokens, classes, orders)
                for c in {classes[t] for t in tokens if t in classes}:
                    sign = f"{orders.get(c)} {sorted(places.get(c, ()))}"
                    good = c in orders and c not in crossing and len(places.get(c, ())) == 1
                    out.add((host, c, xxhash.xxh64_intdigest(sign) - 2**63 if good else None))
            yield pd.DataFrame(list(out), columns=["host", "class", "sign"]).astype({"sign": "Int64"})

    signs = rows.mapInPandas(run, "host string, class bigint, sign bigint").groupBy("host", "class")
    valid = signs.agg((F.count("sign") == F.count("*")).alias("whole"), F.min("sign").alias("a"), F.max("sign").alias("b")).filter("whole AND a = b")
    judged = candidates.join(valid.select("host", "class", F.lit(True).alias("ok")), ["host", "class"], "left")
    return judged.filter("ok OR lone").select("host", "token", F.when(F.col("ok"), F.col("class")).otherwise(F.lit(0)).alias("class"), "lone")


def article_slots(blocks: DataFrame, template: DataFrame) -> DataFrame:
    """(host, slots): the slots whose text is marked as an article for the larger part, over all pages of the host."""
    rows = blocks.select("host", F.transform("blocks", lambda b: b.withField("text", F.length(b["text"]))).alias("blocks")).join(template, "host")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[tuple, int] = {}
            for host, blocks, found in zip(frame["host"], frame["blocks"], frame["classes"], strict=True):
                for slot, b in zip(token_slots(blocks, found), blocks, strict=True):
                    if slot and b["text"] and not b["chrome"]:
                        out[host, slot] = out.get((host, slot), 0) + (b["text"] if b["article"] else -b["text"])
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["host", "slot", "n"])

    sums = rows.mapInPandas(run, "host string, slot string, n bigint").groupBy("host", "slot").agg(F.sum("n").alias("n"))
    return sums.filter("n > 0").groupBy("host").agg(F.collect_list("slot").alias("slots"))


def token_slots(blocks: list[dict], template: list[dict]) -> list[str | None]:
    """The slot of each token, null for tokens of the template."""
    tokens, every = [b["token"] for b in blocks], {x["token"] for x in template}
    classes = {x["token"]: x["class"] for x in template if x["class"]}
    slots, _, _ = page_slots(tokens, classes, page_order(tokens, classes))
    return [None if t in every else f"{c} {n}" for t, (c, n) in zip(tokens, slots, strict=True)]


def page_text(blocks: list[dict], template: list[dict], articles: list[str]) -> str:
    own = [b for b in blocks if b["text"] and not b["chrome"]]
    marked = any(b["article"] for b in own)
    fits = [(b, slot) for b, slot in zip(blocks, token_slots(blocks, template), strict=True) if slot and b["text"] and not b["chrome"]]
    if marked:
        return " ".join(b["text"] for b, _ in fits if b["article"])
    if any(slot in articles for _, slot in fits):
        fits = [(b, slot) for b, slot in fits if slot in articles]
    return " ".join(b["text"] for b, _ in fits)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the article of every page, blocks in page order joined by one space.

    Where a page marks its article, only the article's blocks count, without those of the host's template. Pages of a host
    with the same content count once for the template. A null or empty page has an empty text; null ids and urls stay null
    (such pages share the empty host); repeated rows are pages of their own; an empty table gives an empty result.
    """
    blocks = written(page_blocks(pages), "page-blocks")
    template = by_host(written(valid_classes(blocks, written(candidate_classes(blocks), "page-classes")), "page-template"))
    found = broadcast_if_small(template, HANDED_HOSTS)
    slots = broadcast_if_small(written(article_slots(blocks, found), "article-slots"), HANDED_HOSTS)
    joined = blocks.join(found, "host", "left").join(slots, "host", "left").select("page_id", "url", "blocks", "classes", "slots")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [
                page_text(b, [] if c is None else c, [] if a is None else list(a)) for b, c, a in zip(frame["blocks"], frame["classes"], frame["slots"], strict=True)
            ]
            yield frame[["page_id", "url"]].assign(text=texts)

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"page_id {kind}, url string, text string").select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
