"""Contexts of shared anchors: bytes that hold all the strings to be compared around an anchor.

Documents send the contexts of their anchors, packed by group and dealt by the
anchor's hash. What is equal is found by bytes: hashes only bring contexts together
that may be equal, so a collision can't make two of them one. Of equal contexts in a
group of documents those of the smallest id are sent; a partition does the same with
what it gets. Where an anchor has several distinct contexts, their strings are
compared by a function of the operator's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import groups as G
from .common import part_of, runs, same_bytes

GROUP_BYTES = 24 << 20  # contexts that a task gathers before it sends them
SLICE = 1 << 20  # bytes copied at once
FIELDS = 7


def gather_bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of each, end to end; places are told for about SLICE bytes at a time."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, np.uint8)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(SLICE, total, SLICE)) + 1, [len(ends)])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        begin = ends[a] - size[a]
        out[begin : ends[b - 1]] = data[np.repeat(start[a:b] - (ends[a:b] - size[a:b]), size[a:b]) + np.arange(begin, ends[b - 1])]
    return out


def slices(size: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of contexts of about ``most`` bytes."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(most, total, most)) + 1, [len(ends)])))
    yield from map(slice, cuts[:-1].tolist(), cuts[1:].tolist())


def equal_contexts(anchor: np.ndarray, check: np.ndarray, doc: np.ndarray, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of contexts by anchor, hash and document, and where runs of equal bytes begin.

    Two runs of equal bytes could only come apart where other bytes have the same 64-bit
    hash in the same anchor.
    """
    order = np.lexsort((doc, check, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (check[order[1:]] != check[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
    alike = np.flatnonzero(~new)
    new[alike] = ~same_bytes(text, begin[order[alike]], begin[order[alike - 1]], size[order[alike]])
    return order, np.flatnonzero(new)


@dataclass
class Heads:
    """Distinct contexts of anchors that have several: smallest document of each, number of strings, and bytes."""

    anchor: np.ndarray
    doc: np.ndarray
    count: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    size: np.ndarray


class Sender:
    """Gathers the contexts of a group of documents, about ``most`` bytes of them at a time.

    ``place`` is the place of a context's first string, ``count`` how many strings it has.
    """

    def __init__(self, parts: int, most: int):
        self.parts, self.most, self.group = parts, most, G.Group()

    def send(self, anchor: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray, count: np.ndarray, size: np.ndarray, text: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take in contexts, which are ``size`` bytes of a text from ``start`` on; gives what is full."""
        for part in slices(size, self.most):
            own = gather_bytes(text, start[part], size[part])
            self.group.held.append((anchor[part], check[part], doc[part].astype(np.int64), place[part], count[part].astype(np.int64), size[part].astype(np.int64), own))
            self.group.weight += len(own)
            if self.group.weight >= self.most:
                yield self.flush(close=False)
        if self.group.size >= 1 << 30:
            yield self.flush()

    def flush(self, close: bool = True) -> pa.RecordBatch:
        if not self.group.held:
            return self.group.rows(self.parts, [], None, close=close)
        packer = zstandard.ZstdCompressor(level=3)
        anchor, check, doc, place, count, size, text = (np.concatenate([x[k] for x in self.group.held]) for k in range(FIELDS))
        begin = np.cumsum(size) - size
        order, first = equal_contexts(anchor, check, doc, text, begin, size)
        least = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
        gone = order[doc[order] > least]
        gone = gone[np.argsort(place[gone])]
        left = np.sort(order[doc[order] == least])
        part = part_of(anchor[left], self.parts)
        by = np.argsort(part, kind="stable")
        left, data = left[by], []
        for p, x, y in G.by_part(part[by]):
            own = left[x:y]
            ids, index = np.unique(doc[own], return_inverse=True)
            data.append((p, G.dump(anchor[own], check[own], ids, index.astype(np.uint32), place[own].astype(np.uint32), count[own].astype(np.uint8), size[own].astype(np.uint32)) + packer.compress(gather_bytes(text, begin[own], size[own]).tobytes())))
        return self.group.rows(self.parts, data, (place[gone].astype(np.uint32), count[gone].astype(np.uint32)), close=close)


def covered(rows: DataFrame, compare: Callable[[Heads], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Of each partition, the strings that a smaller id has too.

    ``compare`` tells of heads which strings (number of the head and of the string in it)
    a head of a smaller document with the same anchor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, out = G.incoming(batches)
        if data:
            out += _answer(data, compare)
        yield G.packed(out)

    return rows.mapInArrow(run, G.PACKED)


def _answer(data: list[tuple[int, bytes]], compare: Callable[[Heads], tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, bytes]]:
    fields, texts, grps = [], [], []
    while data:
        grp, payload = data.pop()
        got, rest = G.load_some(payload, FIELDS)
        fields.append(got)
        texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(rest.tobytes()), np.uint8))
        grps.append(np.full(len(got[0]), grp))
    anchor, check, place, count, size = (np.concatenate([f[k] for f in fields]) for k in (0, 1, 4, 5, 6))
    doc = np.concatenate([f[2][f[3]] for f in fields])
    grp, text = np.concatenate(grps), np.concatenate(texts)
    del fields, texts, grps
    count, size = count.astype(np.int64), size.astype(np.int64)
    begin = np.cumsum(size) - size
    order, first = equal_contexts(anchor, check, doc, text, begin, size)
    run_size = np.diff(np.append(first, len(order)))
    later = doc[order] > np.repeat(doc[order][first], run_size)
    answers = [(grp[order[later]], place[order[later]], count[order[later]])]
    many = np.diff(runs(anchor[order[first]]))
    mixed = np.repeat(many > 1, many)
    if mixed.any():
        h = order[first[mixed]]
        where, string = compare(Heads(anchor[h], doc[h], count[h], gather_bytes(text, begin[h], size[h]), np.cumsum(size[h]) - size[h], size[h]))
        # all occurrences of a head in its smallest document share the answer
        copies = np.add.reduceat((~later).astype(np.int64), first)[mixed][where]
        index = np.repeat(first[mixed][where] - (np.cumsum(copies) - copies), copies) + np.arange(int(copies.sum()))
        row = order[index]
        answers.append((grp[row], place[row] + np.repeat(string, copies), np.ones(len(row), np.int64)))
    g, s, k = (np.concatenate([x[i] for x in answers]) for i in range(3))
    by = np.lexsort((s, g))
    return G.answers(g[by], s[by].astype(np.uint32), k[by].astype(np.uint32))
