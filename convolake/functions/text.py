"""Text expressions (Column in, Column out); everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolake.functions import fixed

# White space as the source texts were written against it: ASCII space plus the Unicode spaces.
SPACE = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WIDE_SPACE = r"\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_RE2 = r"\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside a higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(text: Column) -> Column:
    """Line ends unified, runs of white space collapsed, trimmed."""
    for pattern, new in (("\r\n", "\n"), ("\r", "\n"), ("\n{3,}", "\n\n"), (f"[{SPACE}]{{2,}}", " "), ("\t", " ")):
        text = F.regexp_replace(text, pattern, new)
    return trim_space(text)


def token_estimate(text: Column) -> Column:
    """Estimated token count: 1.3 per space-separated word, rounded up; an empty text counts 2."""
    return F.ceil(F.size(F.split(text, " ")) * F.lit(1.3)).cast("bigint")


def sentences(text: Column) -> Column:
    """Sentences, with the abbreviation ``T.C`` kept whole."""
    marked = F.regexp_replace(text, r"T\.C", "T_TEMP_C")
    parts = F.transform(
        F.split(marked, r"[.!?\n]+"), lambda s: F.regexp_replace(trim_space(s), "T_TEMP_C", "T.C")
    )
    return F.filter(parts, lambda s: F.length(s) > 0)


def keywords(text: Column) -> Column:
    """Search words: stop-word and length tests come before symbols are stripped, repeats stay."""
    words = F.filter(
        F.split(F.lower(text), f"[{SPACE}]+"),
        lambda w: (F.length(w) > 2) & ~w.isin(fixed.KEYWORD_STOPWORDS),
    )
    return F.transform(words, lambda w: F.regexp_replace(w, f"[^a-zA-Z0-9_{fixed.TURKISH_LETTERS}]", ""))


def vector_terms(text: Column) -> Column:
    """Terms of a text for the hashed vector, in order, with repeats."""
    # the other letters are looked up only where no ASCII word character is; empty pieces are too short to be terms
    words = F.split(F.lower(text), rf"\W(?<![{fixed.TURKISH_LETTERS}])")
    stop = fixed.VECTOR_STOPWORDS_TR + fixed.VECTOR_STOPWORDS_EN
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def word_set(text: Column) -> Column:
    """Distinct lower-case words longer than two characters, ASCII word characters only."""
    # one look at most characters: wide spaces are looked up only where no ASCII word character or space is
    bare = F.regexp_replace(F.lower(text), rf"[^\w\s](?<![{WIDE_SPACE}])", "")
    return F.array_distinct(F.filter(F.split(bare, r"\W+"), lambda w: F.length(w) > 2))


def text_hash(text: Column) -> Column:
    """Absolute value of the 31-polynomial hash with 32-bit wrap-around."""
    wrap = 4294967296
    h = F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.lit(0).cast("bigint"),
        lambda acc, c: (acc * 31 + F.ascii(c)) % wrap,
    )
    return let(h, lambda v: F.abs(F.when(v >= wrap // 2, v - wrap).otherwise(v)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def truncate_with_notice(text: Column, limit: int = 255) -> Column:
    # Fixed value: the notice text.
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("... [text truncated for brevity]"))).otherwise(text)


def redact(text: Column, limit: int | None = None) -> Column:
    """Hide the first secret of each kind behind its prefix, then shorten if a limit is given."""
    # Patterns of secrets.
    for lead, secret in (("^", "sk-"), ("^(?s:(.*?))", "Bearer "), ("^(?s:(.*?))", "api-key:? "), ("^(?s:(.*?))", "key=")):
        if lead == "^":
            text = F.regexp_replace(text, rf"^({secret})[^{SPACE}]+", "$1[REDACTED]")
        else:
            text = F.regexp_replace(text, rf"{lead}({secret})[^{SPACE}]+", "$1$2[REDACTED]")
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def middle_truncate(text: Column, limit: int = 255) -> Column:
    """First and last half around an ellipsis, notice at the end."""
    notice = " [text truncated for brevity]"
    half = (limit - len("...") - len(notice)) // 2
    short = F.concat(F.substring(text, 1, half), F.lit("..."), F.right(text, F.lit(half)), F.lit(notice))
    return F.when(F.length(text) > limit, short).otherwise(text)


def contains_ci(column: Column, literal: str) -> Column:
    return F.lower(column).contains(literal.lower())


def scaled_bytes(n: Column) -> Column:
    """Byte count scaled by the largest fitting power of 1024, two decimals."""
    step = F.floor(F.log2(n.cast("double")) / 10)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(n / F.pow(F.lit(1024.0), step), 2))


def title_or(title: Column, default: str) -> Column:
    return F.coalesce(F.when(title != "", title), F.lit(default))
