"""Steps whose core a caller brings: chunkers as table functions and page extractors over binary files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.functions import fixed
from convolake.functions.tokenizers import ESTIMATE, Counts, Tokenizer

CHUNK_ROW = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("tokens", T.LongType())])
PAGE_ROW = "path string, page int, text string, error string"

# White space as in functions.text.SPACE.
_SPACE = "".join(map(chr, (0x20, *range(0x09, 0x0E), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def sentence_chunks(text: str, counts: Counts, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP) -> Iterator[str]:
    """Sentences packed up to ``size`` tokens of any tokenizer; see ``functions.chunks`` for the rules."""
    parts = (p.strip(_SPACE).replace("T_TEMP_C", "T.C") for p in re.split(r"[.!?\n]+", text.replace("T.C", "T_TEMP_C")))
    sentences = [p for p in parts if p]
    held, tokens = "", 0
    for sentence, n in zip(sentences, counts(sentences), strict=True):
        if n > size:
            if held:
                yield held
            held, tokens = "", 0
            piece, used = [], 0
            words = sentence.split(" ")
            for word, cost in zip(words, counts(words), strict=True):
                if used + cost > size:
                    yield " ".join(piece)
                    piece, used = [], 0
                piece.append(word)
                used += cost
            yield " ".join(piece)
        elif tokens + n > size:
            yield held
            held = f"{_tail(held, counts, overlap)} {sentence}"
            tokens = counts([held])[0]
        else:
            held = f"{held} {sentence}" if held else sentence
            tokens += n
    if held:
        yield held


def _tail(text: str, counts: Counts, overlap: int) -> str:
    """The text, or its fewest closing words worth ``overlap`` tokens."""
    if counts([text])[0] <= overlap:
        return text
    if hasattr(counts, "ends"):  # all endings at the price of one
        text = text.rstrip(" ")
        starts = [i + 1 for i in range(len(text) - 1, -1, -1) if text[i] == " "] + [0]
        return next((text[s:] for s, n in zip(starts, counts.ends(text, starts)) if n >= overlap), text)
    words, tail = text.split(" "), ""
    while words and (not tail or counts([tail])[0] < overlap):
        word = words.pop()
        tail = f"{word} {tail}" if tail else word
    return tail


def chunker(tokenizer: Tokenizer = ESTIMATE, split: Callable[[str, Counts], Iterable[str]] = sentence_chunks):
    """A table function: one text in, its chunks in order out. Null, empty and blank texts give no rows."""
    load = tokenizer.load

    class Chunker:
        def __init__(self):
            self.counts = load()

        def eval(self, text: str):
            found = [c for c in (c.strip(_SPACE) for c in split(text or "", self.counts)) if c]
            yield from zip(range(len(found)), found, self.counts(found), strict=True)

    return F.udtf(Chunker, returnType=CHUNK_ROW, useArrow=True)


def register_chunker(spark: SparkSession, name: str, function) -> None:
    """Makes a chunker callable from SQL: ``SELECT … FROM texts, LATERAL name(texts.text)``."""
    spark.udtf.register(name, function)


def chunk_rows(df: DataFrame, text: str, function) -> DataFrame:
    """The rows of ``df``, without ``text``, laterally joined with the chunks of their text."""
    return df.lateralJoin(function(F.col(text).outer())).drop(text)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def extract_pages(files: DataFrame, extractor: Callable[[str, bytes], Iterable[str]], rows: int = 256, size: int = 4 << 20) -> DataFrame:
    """(path, page, text, error): the pages, from 1, that ``extractor(path, content)`` gives for each file.

    Pages leave a task in batches of at most ``rows`` rows and about ``size`` characters while the extractor goes on, so
    a long document is never held as pages. Where it raises, the file keeps the pages it has given so far and gets one
    row with the error and no page; other files are not touched. A file without content gives the same kind of row, a
    file without pages none.
    """

    def batch(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "page", "text", "error"])

    def pages(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            if content is None:
                raise ValueError("no content")
            for number, text in enumerate(extractor(path, content), 1):
                yield path, number, text, None
        except Exception as e:  # noqa: BLE001 - whatever a caller's library raises concerns this file alone
            yield path, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = [], 0
        for given in batches:
            for i in range(given.num_rows):
                for row in pages(given.column(0)[i].as_py(), given.column(1)[i].as_py()):
                    held.append(row)
                    used += len(row[2] or "")
                    if len(held) >= rows or used >= size:
                        yield batch(held)
                        held, used = [], 0
        if held:
            yield batch(held)

    return files.select("path", "content").mapInArrow(run, PAGE_ROW)
