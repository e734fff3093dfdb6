"""Operator 1: vector best-fit packing of documents into sequences.

A sequence is a bin with three capacities: tokens, documents and attention cost
(the sum of the squared lengths of its pieces). Pieces are placed in order of
falling length. Among the open bins where a piece fits under every capacity, the
one with the smallest weighted norm of what is left is taken (``by="norm"``), or
the one with the largest weighted dot product of demand and residual (``by="dot"``).

A demand depends on the length alone, so the whole packing follows from how many
pieces there are of each length: at most ``max_tokens`` counts, whatever the size
of the corpus. That histogram is all the driver sees. The plan it yields maps ranks
within a length to runs of sequences, and each piece looks its rank up in it.

Defined results: null and empty texts are the end token alone; a document longer
than a sequence is cut into full pieces and a rest; pieces of equal length are
interchangeable and are ranked by the task and the order they were read in; repeated rows are
packed as often as they occur; a very long text is tokenized whole by one task and leaves it in pieces;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_view, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def merge_pairs(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges of pairs by rank, leftmost first."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best[0] == len(ranks):
            break
        symbols[best[1] : best[1] + 2] = ["".join(symbols[best[1] : best[1] + 2])]
    return symbols


class WordTokenizer:
    """Ids of a byte-level BPE tokenizer with word ends that lower-cases and drops white space.

    Texts of ASCII and Latin letters need no normalisation beyond lower case. Their words
    are cut by a plain pattern, each gets the byte 0 as its end, and a second encoder
    merges them: its ranks have a letter and the end first and then the tokenizer's
    merges in order, by the bytes of what they make. A token that its own letters don't
    merge to is left out, as the tokenizer can't make it; of the others only the pair
    that makes a token can come to stand side by side, so merges by bytes are merges by
    pair. All other texts go to the tokenizer itself.
    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranks, ids, order = {bytes([b]): b for b in range(256)}, [0] * 512, {m: i for i, m in enumerate(merges)}
        letter_bytes = self._letter_bytes()
        for letter, b in letter_bytes.items():
            ranks[bytes([b, 0])] = 256 + b
            ids[b], ids[256 + b] = vocab[letter], vocab[letter + end]
        for a, b in merges:
            token = a + b
            body = token.removesuffix(end)
            symbols = list(body) if body == token else [*body[:-1], body[-1] + end]
            if len(symbols) > 1 and merge_pairs(symbols, order) == [token]:
                ranks[bytes(letter_bytes[c] for c in body) + (b"" if body == token else b"\0")] = len(ids)
                ids.append(vocab[token])
        self.ids = np.array(ids, "<u4")
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _letter_bytes() -> dict[str, int]:
        """The bytes that a byte-level vocabulary's letters stand for: printable ones themselves, the others from U+0100 on."""
        from tokenizers.pre_tokenizers import ByteLevel

        letters = set(ByteLevel.alphabet())
        own = {chr(b): b for b in range(256) if chr(b) in letters}
        out = own | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in own)}
        if set(out) != letters:
            raise ValueError("the vocabulary maps bytes to letters in another way")
        return out

    def encode(self, text: str) -> bytes:
        """32-bit ids."""
        if _UNUSUAL.search(text):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = _WORDS.findall(text.lower())
        if not words:
            return b""
        words.append("")
        return self.ids[self.merger.encode_to_numpy("\0".join(words), disallowed_special=())].tobytes()


# Latin letters that lower-casing and composition leave one letter each, and the marks of some languages beside ASCII.
_LETTERS, _MARKS = "a-z\xdf-\xf6\xf8-\xff", "\xa1\xab\xbb\xbf"
_UNUSUAL = re.compile(f"[^\t-\r -~\xc0-\xd6\xd8-\xde{_LETTERS}{_MARKS}]")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[!-/:-@\\[-`{{-~{_MARKS}]+")


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and the weight of each dimension when bins are compared."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    by: str = "norm"

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)

    def total(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


class Plan:
    """Runs (length, first rank, count, first sequence, offset): rank first + i is in sequence first + i."""

    def __init__(self, counts: dict[int, int], capacity: Capacity):
        total, weights = capacity.total(), np.array(capacity.weights) / capacity.total()
        left, first, many = np.zeros((1024, 3), np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        groups, sequences, out = 0, 0, []

        def opened(residual: np.ndarray, start: int, count: int) -> None:
            nonlocal left, first, many, groups
            if groups == len(first):
                left, first, many = (np.concatenate([x, np.zeros_like(x)]) for x in (left, first, many))
            left[groups], first[groups], many[groups] = residual, start, count
            groups += 1

        for length in sorted(counts, reverse=True):
            need, rank, count = capacity.demand(length), 0, counts[length]
            if (need > total).any():
                raise ValueError(f"a piece of {length} tokens fits in no sequence")
            while count:
                fits = np.flatnonzero((left[:groups] >= need).all(axis=1) & (many[:groups] > 0))
                if len(fits):
                    after = (left[fits] - need) * weights
                    score = (after * after).sum(axis=1) if capacity.by == "norm" else -(left[fits] * weights * (need * weights)).sum(axis=1)
                    g = fits[np.argmin(score)]
                    k = int(min(count, many[g]))
                    out.append((length, rank, k, int(first[g]), int(capacity.tokens - left[g][0])))
                    start, residual = int(first[g]), left[g] - need
                    first[g] += k
                    many[g] -= k
                    if many[g]:
                        opened(residual, start, k)
                    else:
                        left[g], first[g], many[g] = residual, start, k
                    rank, count = rank + k, count - k
                    continue
                each = int(min(total[i] // need[i] for i in range(3)))  # of this length in a new bin
                for bins, in_each in ((count // each, each), (1, count % each)):
                    if not bins or not in_each:
                        continue
                    for j in range(in_each):
                        out.append((length, rank, bins, sequences, j * length))
                        rank += bins
                    opened(total - need * in_each, sequences, bins)
                    sequences += bins
                count = 0
            full = (left[:groups] >= 1).all(axis=1) & (many[:groups] > 0)  # full bins need no further look
            if groups - full.sum() > 512:
                keep = np.flatnonzero(full)
                left, first, many = (np.concatenate([x[keep], np.zeros_like(x[:1024])]) for x in (left, first, many))
                groups = len(keep)
        runs = np.array(sorted(out), np.int64).reshape(-1, 5)
        self.sequences = sequences
        self.key = runs[:, 0] << 44 | runs[:, 1]  # lengths and ranks are below 2**19 and 2**44
        self.rank, self.sequence, self.offset = runs[:, 1], runs[:, 3], runs[:, 4]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def pieces_of(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int, most: int) -> DataFrame:
    """Cut each document's ids, the end token included, into pieces of at most ``most`` tokens.

    ``task`` and ``nth`` number the pieces of a length within each task.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    ids = encode(text.as_py() or "") + end
                    for piece, start in enumerate(range(0, len(ids), 4 * most)):
                        raw = ids[start : start + 4 * most]
                        n = len(raw) // 4
                        rows.append((doc, piece, start // 4, n, zlib.crc32(raw), task, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names)

    return documents_view(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int = 1, capacity: Capacity = Capacity()) -> DataFrame:
    """Pack all documents; see the module. ``encoder()`` gives, in a worker, a function from text to ids."""
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, encoder, end_id, capacity.tokens), "pieces")
    per_task = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity.tokens rows
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)


def word_encoder(path: str) -> Callable[[], Callable[[str], bytes]]:
    """An encoder for ``pack`` from a tokenizer file."""
    return lambda: word_tokenizer(path).encode
