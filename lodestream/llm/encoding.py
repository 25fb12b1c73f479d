"""Problem 8: the corpus as ids of a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the vocabulary: one piece for each byte string,
written in the usual printable alphabet of bytes and scored by its negative rank, with identity
normalisation. Texts are cut into pre-tokens by the vocabulary's pattern, each different pre-token of a
batch is encoded once, and ids are joined again. Decoding maps pieces back to bytes.

Defined results: null and empty texts give an empty list; strings that look like special tokens are
plain text; repeated rows come out as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE_PIECES = 200_000


def _alphabet() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary in the order of their ids."""
    rows = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return [token for _, token in sorted((int(rank), base64.b64decode(token)) for token, rank in rows)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a message or string, a number or a float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(path: str) -> bytes:
    """The serialised sentencepiece model; piece 0 is the unknown one, so its ids are ours plus 1."""
    letters = _alphabet()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) for rank, token in enumerate(read_ranks(path))]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary; built once for each worker."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(path))
        self.letters = _alphabet()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > _CACHE_PIECES:
            self.known.clear()
        mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in words]
        for w, ids in zip(words, self.model.encode(mapped, num_threads=1)):
            self.known[w] = np.array(ids, np.int32) - 1

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        words = [self.cut(t) if t else [] for t in texts]
        fresh = list({w for ws in words for w in ws if w not in self.known})
        if len(self.known) + len(fresh) > _CACHE_PIECES:
            fresh = list({w for ws in words for w in ws})
        if fresh:
            self._learn(fresh)
        parts = [self.known[w] for ws in words for w in ws]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), total[np.cumsum(counts)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return bytes(self.bytes[c] for i in ids for c in self.model.id_to_piece(int(i) + 1)).decode("utf-8", "surrogatepass")


@cache
def codec(path: str = VOCABULARY) -> Codec:
    return Codec(path)


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, ends = own.encode_batch(part.column(1).to_pylist())
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``: the inverse of ``encode_documents`` (null comes back as an empty text)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
