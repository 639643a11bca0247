"""Vector expressions: hashed term dimensions, dot product, norm, cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions import fixed
from convolake.functions.text import let, text_hash, vector_terms


def term_dims(text: Column, dims: int = fixed.VECTOR_DIMS) -> Column:
    """Dimension of every term occurrence that feeds the vector.

    Only the first ``dims`` distinct terms count; whole numbers come first in ascending order, other terms follow in
    order of appearance.
    """
    is_index = lambda t: t.rlike("^[1-9][0-9]{2,9}$") & (t.cast("bigint") < 4294967295)

    def leading(distinct: Column) -> Column:
        numbers = F.array_sort(F.transform(F.filter(distinct, is_index), lambda t: t.cast("bigint")))
        ordered = F.concat(
            F.transform(numbers, lambda n: n.cast("string")), F.filter(distinct, lambda t: ~is_index(t))
        )
        return F.slice(ordered, 1, dims)

    def used(terms: Column) -> Column:
        return let(
            F.array_distinct(terms),
            lambda distinct: F.when(F.size(distinct) <= dims, terms).otherwise(
                let(leading(distinct), lambda first: F.filter(terms, lambda t: F.array_contains(first, t)))
            ),
        )

    return F.transform(let(vector_terms(text), used), lambda t: (text_hash(t) % dims).cast("int"))


TEXT_BYTES = 4_000_000  # of texts whose terms are looked at together
KEPT_TERMS = 500_000
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_PAIRS = np.zeros(1 << 16, bool)  # the two bytes of a letter beyond ASCII
_PAIRS[[int.from_bytes(c.encode(), "big") for c in fixed.TURKISH_LETTERS if ord(c) > 127]] = True
_STOP = {*fixed.VECTOR_STOPWORDS_TR, *fixed.VECTOR_STOPWORDS_EN}


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, term) of every term occurrence in order, terms as numbers, and the terms; as ``vector_terms`` of lower-case texts."""
    coded = [b"" if t is None else t.encode() for t in texts.to_pylist()]
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    ends = np.cumsum(np.array([len(t) + 1 for t in coded], np.int64))
    word = _WORD[data]
    if len(data) > 1:
        wide = np.flatnonzero(_PAIRS[data[:-1].astype(np.uint16) << 8 | data[1:]])
        word[wide] = word[wide + 1] = True
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # bytes that begin no character
    long = end - start - (more[end] - more[start]) > 2
    start, end = start[long], end[long]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    body = data[np.cumsum(inside[:-1]).astype(bool)]
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(body.tobytes())).dictionary_encode()
    term, text = found.indices.to_numpy(), np.searchsorted(ends, start, "right")
    stays = np.array([t not in _STOP for t in found.dictionary.to_pylist()], bool)
    kept = stays[term] if len(term) else np.empty(0, bool)
    return text[kept], term[kept], found.dictionary


def _term_hash(term: str) -> int:
    h = 0
    for c in term:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def _index(term: str) -> int:
    """The number that a term stands for as an index; -1 for others."""
    if term[0] in "123456789" and 3 <= len(term) <= 10 and term.isascii() and term.isdigit() and int(term) < 4294967295:
        return int(term)
    return -1


def _counts(texts: pa.Array, dims: int, known: dict[str, int]) -> np.ndarray:
    """Term occurrences of each text by dimension; of the terms of a text that ``term_dims`` lets through."""
    text, term, names = terms_of(texts)
    if len(known) > KEPT_TERMS:
        known.clear()
    listed = names.to_pylist()
    for name in listed:
        if name not in known:
            known[name] = (_index(name) + 1) * dims + _term_hash(name) % dims
    packed = np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))
    dim, index = packed % dims, packed // dims - 1
    times = np.bincount(text, minlength=len(texts))
    many = (times > dims)[text]  # only these can have too many distinct terms
    cells = [text[~many] * dims + dim[term[~many]]]
    text, term = text[many], term[many]
    if len(text):
        both, first, tf = np.unique(text * len(names) + term, return_index=True, return_counts=True)
        of, term = both // len(names), both % len(names)
        number = index[term]
        order = np.lexsort((np.where(number >= 0, number, first), number < 0, of))
        of, term, tf = of[order], term[order], tf[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        cells.append(np.repeat(of * dims + dim[term], np.where(place < dims, tf, 0)))
    return np.bincount(np.concatenate(cells), minlength=len(texts) * dims).reshape(len(texts), dims)


def parts(batch: pa.RecordBatch, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def with_hashed_vector(df: DataFrame, key: str, text: str, dims: int = fixed.VECTOR_DIMS) -> DataFrame:
    """(key, vector): length-1 counts of the hashed terms; all zeros for a text without terms.

    Terms are found and counted for some texts at a time, so a task holds a few MB of them whatever its input.
    """

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for part in parts(batch):
                counts = _counts(part.column(1), dims, known).astype(np.float64)
                length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                counts = np.divide(counts, length, out=counts, where=length > 0)
                offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * np.int32(dims))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(counts.reshape(-1)))], names=[key, "vector"])

    return df.select(F.col(key).cast("bigint"), F.lower(text).alias("text")).mapInArrow(dense, f"{key} bigint, vector array<double>")


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) by row of ``df``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                row, term, names = terms_of(part.column(1))
                both, tf = np.unique(row * max(1, len(names)) + term, return_counts=True)
                row, term = pa.array(both // max(1, len(names))), pa.array(both % max(1, len(names)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), names.take(term), pa.array(tf)], names=[key, "term", "tf"])

    return df.select(F.col(key).cast("bigint"), F.lower(text).alias("text")).mapInArrow(count, f"{key} bigint, term string, tf bigint")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a null vector, unequal lengths or a zero norm."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))
