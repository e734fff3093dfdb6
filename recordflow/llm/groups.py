"""Packed exchanges between documents and hash partitions.

Searching for repeats means comparing the hash of nearly every place of every
document. As rows, the hashes would be several times the size of the text. Here a
task gathers some documents into a group, numbers the places of the group, and
sends one packed row per hash partition: sorted hashes as differences, cut into
byte planes so that the shuffle's compression removes the upper ones. A partition
answers with places of groups, and ``per_document`` turns those into spans of
documents with the help of each group's table of documents.

Rows that repeat (same id and text) share a key (id, hash of the text), so that
their spans agree; rows without an id take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view, trim

DATA, DOCS, FOUND, ALIKE = 0, 1, 2, 3  # kinds of packed rows: for a partition, a group's documents, places found, places that share another's answer
PACKED = "part int, grp long, kind int, payload binary"
NAMES = ["part", "grp", "kind", "payload"]
SPANS = "doc_id long, tag long, spans binary"


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, upper bytes apart from lower ones."""
    out = []
    for a in arrays:
        code = a.dtype.str[1:].encode()
        out += [struct.pack("<2sQ", code, len(a)), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""]
    return b"".join(out)


def load(data: bytes) -> list[np.ndarray]:
    return load_some(data, None)[0]


def load_some(data: bytes, most: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The first ``most`` arrays, or all, and the bytes after them."""
    out, at = [], 0
    while at < len(data) and len(out) != most:
        code, n = struct.unpack_from("<2sQ", data, at)
        kind = np.dtype("<" + code.decode())
        at += 10
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out, np.frombuffer(data, np.uint8)[at:]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and tag, a hash of the text, of rows with an id and a text."""
    own = documents_view(docs)
    return own.withColumn("tag", F.xxhash64("text"))


BATCH_BITS = 48  # of a group's number, below the number of its batch


class Group:
    """Documents whose places are numbered together; its number tells batch, task and place in the task."""

    def __init__(self, batch: int = 0) -> None:
        self.task, self.n = batch << 24 | TaskContext.get().partitionId(), 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.tags, self.bases, self.size, self.held = [], [], [], 0, []
        self.weight = 0

    def add(self, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number the places of more documents; gives the first of each."""
        bases = self.size + np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
        self.ids.append(ids.astype(np.int64))
        self.tags.append(tags.astype(np.int64))
        self.bases.append(bases.astype(np.int64))
        self.size += int(lengths.sum())
        return bases

    def rows(self, parts: int, data: list[tuple[int, bytes]], found: tuple[np.ndarray, ...] | None, alike: tuple[np.ndarray, np.ndarray] | None = None, close: bool = True) -> pa.RecordBatch:
        """What the group holds as packed rows. ``alike``: places, and those whose answers they share.

        A group that is not closed goes on with the same documents, and tells of these later.
        """
        grp = self.task << 24 | self.n
        home = grp * 2654435761 % parts
        out = [(p, grp, DATA, payload) for p, payload in data]
        if close:
            out.append((home, grp, DOCS, dump(np.concatenate(self.ids), np.concatenate(self.tags), np.concatenate(self.bases))))
        if found is not None and len(found[0]):
            out.append((home, grp, FOUND, dump(*found)))
        if alike is not None and len(alike[0]):
            out.append((home, grp, ALIKE, dump(*alike)))
        if close:
            self.n += 1
            self.clear()
        self.held, self.weight = [], 0
        return packed(out)


def packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], NAMES)


def by_part(order_part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal partitions: partition, start, end."""
    if len(order_part):
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(order_part)) + 1, [len(order_part)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(order_part[a]), int(a), int(b)


def incoming(batches: Iterator[pa.RecordBatch]) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, int, bytes]]]:
    """A partition's packed rows: data by group, and what only passes through."""
    trim()
    data, through = [], []
    for batch in batches:
        for part, grp, kind, payload in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
            if kind == DATA:
                data.append((grp, payload))
            else:
                through.append((part, grp, kind, payload))
    return data, through


def answers(grp: np.ndarray, *fields: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Found places, and what is told of them, as packed rows, one for each group."""
    order = np.argsort(grp, kind="stable")
    grp, fields = grp[order], [f[order] for f in fields]
    return [(0, g, FOUND, dump(*(f[a:b] for f in fields))) for g, a, b in by_part(grp)]


def per_document(rows: DataFrame, parts: int, once: bool = True) -> DataFrame:
    """What was found of each document, from packed rows: its places from 0, and what is told of them.

    With ``once`` rows of equal id and tag, which repeat and are told the same, give one row.
    """
    dealt = rows.repartition(parts, "grp").sortWithinPartitions("grp", "kind")

    def close(held: list, table: list | None, alike: list) -> pa.RecordBatch | None:
        if not held or table is None:
            return None
        ids, tags, bases = table
        fields = [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]
        if alike:
            place, like = (np.concatenate([x[k] for x in alike]) for k in (0, 1))
            order = np.argsort(like)
            place, like = place[order], like[order]
            a, b = np.searchsorted(like, fields[0], "left"), np.searchsorted(like, fields[0], "right")
            times = b - a
            more = np.repeat(a - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            fields = [np.concatenate([fields[0], place[more]])] + [np.concatenate([f, np.repeat(f, times)]) for f in fields[1:]]
        order = np.argsort(fields[0], kind="stable")
        start, rest = fields[0][order].astype(np.int64), [f[order] for f in fields[1:]]
        doc = np.searchsorted(bases, start, "right") - 1
        start = (start - bases[doc]).astype(np.uint32)
        out = [(d, dump(start[a:b], *(f[a:b] for f in rest))) for d, a, b in by_part(doc)]
        at = [d for d, _ in out]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(tags[at]), pa.array([s for _, s in out], pa.binary())], ["doc_id", "tag", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, table, alike = [], None, None, []
        for batch in batches:
            for grp, kind, payload in zip(*(batch.column(c).to_pylist() for c in NAMES[1:]), strict=True):
                if grp != now:
                    if (done := close(held, table, alike)) is not None:
                        yield done
                    held, now, table, alike = [], grp, None, []
                if kind == DOCS:
                    table = load(payload)
                else:
                    (held if kind == FOUND else alike).append(load(payload))
        if (done := close(held, table, alike)) is not None:
            yield done

    out = dealt.mapInArrow(run, SPANS)
    return out if not once else out.groupBy("doc_id", "tag").agg(F.first("spans").alias("spans"))


def deal(rows: DataFrame, parts: int) -> DataFrame:
    """Each packed row to the partition that it names."""
    return rows.repartitionById(parts, F.col("part"))
