"""Operator 6: byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised here, straight from the vocabulary's ranks: each byte is
mapped to the letter U+0100 + byte, a piece's score is its negative rank, and
normalisation is the identity. sentencepiece's merges (best score first, leftmost
on ties) are then the merges of the ranks. Pre-tokens are encoded one at a time
and decoding is the inverse mapping of the pieces.

Defined results: null and empty texts have no tokens; a pre-token that is itself
in the vocabulary is that one token, as tiktoken has it, even where no chain of
merges leads to it. Other columns of the input are ignored; repeated rows give
repeated results; a very long text is encoded whole by one task; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_view

LETTER = 0x100  # byte b is the letter U+0100 + b
CACHE_ENTRIES = 500_000  # segments kept by a worker
CACHE_CHARS = 48  # longer segments are rare and not kept
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


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


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 piece and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f) if piece}


def to_letters(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_letters())


@functools.cache
def _letters() -> dict[int, int]:
    return {b: LETTER + b for b in range(256)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; one unknown piece follows them."""
    normal, unknown, bpe = 1, 2, 2  # fixed values of the format
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    pieces = [_field(1, to_letters(p).encode()) + _field(2, -float(r)) + _field(3, normal) for r, p in enumerate(order)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(order)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes with the serialised model."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.pieces = [bytes(ord(c) - LETTER for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}

    def _pre_token(self, token: str) -> list[int]:
        raw = token.encode()
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.model.encode(to_letters(raw))

    def _segment(self, segment: str) -> bytes:
        ids = [i for token in self.pattern.findall(segment) for i in self._pre_token(token)]
        out = np.array(ids, "<u4").tobytes()
        if len(segment) <= CACHE_CHARS:
            if len(self.kept) >= CACHE_ENTRIES:
                self.kept.clear()
            self.kept[segment] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        No match of the pattern has a space after another character than white
        space, so text can be cut before such spaces and the segments kept.
        """
        if _SPACE_THEN_BLANK.search(text):
            return self._segment(text)
        kept = self.kept.get
        return b"".join([kept(s) or self._segment(s) for s in _SEGMENTS.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_SPACE_THEN_BLANK = re.compile(r"[^\S ] ")
_SEGMENTS = re.compile(r" *[^ ]+| +")


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: tokens, SHA-256 of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, ids_sha, text_sha = [], [], []
                for text in part.column("text"):
                    ids = own.encode(text.as_py() or "")
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_view(docs).mapInArrow(run, SCHEMA)
