"""Byte-level BPE: encoding of whole texts pre-token by pre-token, with a bounded memory of pre-tokens already seen.

``sentencepiece_model`` writes the ranks of a byte-level vocabulary as a sentencepiece BPE model: every byte string is
mapped to printable characters (one per byte), scored by its negative rank, with identity normalisation. Merging by
highest score is then merging by lowest rank, so the library's ids are the ranks.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from convolake.llm.common import id_and_text, slices

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEEN = 400_000  # pre-tokens remembered by a task; the memory is emptied when full, results do not depend on it
LONG = 2_000_000  # characters beyond which a text is cut into pre-tokens piecewise
WHOLE = 200_000  # characters up to which a text may go to a library whole: tiktoken's split fails on longer runs of white space


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it is printable in Latin-1, else the next code from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def mapped(data: bytes, table: dict[int, str]) -> str:
    return data.decode("latin-1").translate(table)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose id of a piece is its rank; the unknown piece follows the last rank."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    normal, unknown, bpe = 1, 2, 2
    table = dict(enumerate(byte_characters()))
    out = bytearray()
    for data, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = _field(1, mapped(data, table).encode()) + _field(2, -float(rank)) + _field(3, normal)
        out += _field(1, piece)
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    out += _field(2, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


Encoder = Callable[[list[str]], list[bytes]]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def sentencepiece_encoder(ranks: dict[bytes, int], model: bytes) -> Encoder:
    """Pre-tokens to packed ids: a pre-token that is itself a vocabulary entry is that entry, others are merged."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = dict(enumerate(byte_characters()))

    def encode(words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out = [ranks.get(r) for r in raw]
        rest = [i for i, rank in enumerate(out) if rank is None]
        found = processor.encode([mapped(raw[i], table) for i in rest], out_type=int, num_threads=1)
        result = [packed([rank]) if rank is not None else b"" for rank in out]
        for i, ids in zip(rest, found, strict=True):
            result[i] = packed(ids)
        return result

    return encode


def merging_encoder(path: str) -> tuple[Encoder, dict[str, int], Callable[[str], list[int]] | None]:
    """Pre-tokens to packed ids for a tokenizers file of a byte-level BPE, its special strings, and, where there is one, the
    library's own way from a whole text without them to ids.

    Where merges are numbered like the vocabulary, as in the files of this family, merging by lowest id is what the
    tokenizers library does; any other file goes through that library itself.
    """
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
    vocabulary = described["model"]["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in described["model"]["merges"]]
    back = {c: b for b, c in enumerate(byte_characters())}
    if all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        import tiktoken

        ranks = {bytes(back[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        single = getattr(core, "_encode_single_piece", core.encode_ordinary)  # without a second split, where offered

        def encode(words: list[str]) -> list[bytes]:
            return [packed(single(w)) for w in words]

        return encode, special, core.encode_ordinary
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda words: [packed(e.ids) for e in whole.encode_batch(words, add_special_tokens=False)], special, None


class TextEncoder:
    """Whole texts to packed ids, by ``whole`` where it is given and the text is no longer than WHOLE characters.

    Otherwise by pre-tokens, of which a bounded number is remembered.
    """

    def __init__(self, encode: Encoder, special: dict[str, int] | None = None, whole: Callable[[str], list[int]] | None = None, seen: int = SEEN):
        import regex

        self.pattern = regex.compile(PATTERN)
        self.special = special or {}
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        self.encode, self.whole, self.seen = encode, whole, seen
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[list[str]]) -> None:
        needed = set(itertools.chain.from_iterable(words))
        new = list(needed - self.known.keys())
        if len(self.known) + len(new) > self.seen:
            self.known.clear()
            new = list(needed)
        self.known.update(zip(new, self.encode(new), strict=True))

    def _long(self, text: str) -> bytes:
        found = (m.group() for m in self.pattern.finditer(text))
        out = []
        while part := list(itertools.islice(found, 200_000)):
            self._learn([part])
            out.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(out)

    def _plain(self, texts: list[str]) -> list[bytes]:
        if self.whole is not None:
            return [packed(self.whole(t)) if len(t) <= WHOLE else self._long(t) for t in texts]
        words = [self.pattern.findall(t) if len(t) <= LONG else [] for t in texts]
        self._learn(words)
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        return [self._long(t) if len(t) > LONG else x for t, x in zip(texts, out, strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        out = []
        for t in texts:
            parts = [p for p in self.cut.split(t) if p]
            ids = iter(self._plain([p for p in parts if p not in self.special]))
            out.append(b"".join(packed([self.special[p]]) if p in self.special else next(ids) for p in parts))
        return out


def encoded(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit) and decoded (the bytes the ids stand for) of every text.

    A null or empty text gives no ids and no bytes; a null doc_id stays null; rows are independent of each other.
    """
    return id_and_text(docs).mapInArrow(
        lambda batches: _encode(batches, ranks_path, lambda ids, back: (ids, back)),
        "doc_id bigint, ids binary, decoded binary",
    )


def encoded_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of ``encoded``, without moving ids between processes."""

    def digest(ids: bytes, back: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    return id_and_text(docs).mapInArrow(
        lambda batches: _encode(batches, ranks_path, digest),
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


def _encode(batches: Iterator[pa.RecordBatch], path: str, result: Callable) -> Iterator[pa.RecordBatch]:
    import numpy as np

    ranks = read_ranks(path)
    encoder = TextEncoder(sentencepiece_encoder(ranks, sentencepiece_model(ranks)))
    # The inverse mapping: piece characters back to bytes.
    back = {c: b for b, c in enumerate(byte_characters())}
    table = dict(enumerate(byte_characters()))
    entries = [bytes(back[c] for c in mapped(r, table)) for r, _ in sorted(ranks.items(), key=lambda x: x[1])]
    for doc_ids, texts in slices(batches):
        rows = []
        for ids in encoder(texts):
            decoded = b"".join(map(entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            rows.append(result(ids, decoded))
        columns = [pa.array(doc_ids, pa.int64()), *map(pa.array, zip(*rows, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
