"""Operator 7: removal of repeated byte strings by a logarithmic family of suffix arrays.

A string of ``length`` bytes belongs to its anchor: the ``GRAM`` bytes in it whose
hash is least, leftmost on ties. Where a string is repeated, so is its anchor at the
same distance, so repeats only need to be sought among the places of one anchor.

1. Anchors are dealt by hash, each once for a group of documents; those that occur once
   in all are done with.
2. Each occurrence of the others sends its context: the bytes of all the strings that
   belong to it. Contexts that one group of documents shares are sent once, for the
   smallest id. Anchors with very many occurrences send each string as a context of
   its own, dealt by its own hash, so no anchor gathers in one task.
   Documents whose whole text a smaller id has (by SHA-256) send none: all their strings are repeats.
3. A partition takes its contexts in some batches of rising id. A context whose bytes were
   seen before is covered. Each batch of the others, where an anchor has several, gets a
   suffix array of the strings whose hash another document has too: the places of its strings in the order of their bytes. It is merge-scanned against the
   arrays of the levels so far for matches, becomes the lowest level, and levels of like size
   merge, so that sizes are geometric and a suffix is merged a logarithmic number of times.
   Hashes only bring together what may be equal; bytes decide what goes.
4. Documents drop the covered bytes.

Defined results: null and empty texts have no bytes; a document without an id is no
source and keeps all its bytes; documents of equal id never remove each other's bytes;
matches never cross documents; repeated rows give repeated results; very long texts are
handled whole, one at a time; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups as G
from .blocks import spread
from .common import SALTS, U64, chunks, discard, eights, join_hashes, materialise, mix, part_of, partitions, runs
from .contexts import GROUP_BYTES, Heads, Sender, covered, gather_bytes, slices

GRAM = 25
GROUP_ANCHORS = 1_500_000  # anchors of a group of documents
STRETCH = 1 << 13  # places that are hashed at once
ANCHOR_BYTES = 1 << 17  # text whose anchors are sought at once
BATCH = 1 << 16  # strings that get a suffix array together, at least
BATCHES = 8  # of a partition, about, at most
COMMON = 2000  # an anchor that more groups of documents hold sends single strings
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
LOW = U64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the strings of GRAM bytes that start at each byte: of two halves of 16, from their bytes eight at a time.

    A stretch of places is done at once, so that what it takes stays in the processor's cache.
    """
    out = np.empty(max(0, len(data) - GRAM + 1), U64)
    for at in range(0, len(out), STRETCH):
        part = mix(eights(data[at : at + STRETCH + GRAM - 1]) ^ U64(SALTS[1]))
        half = join_hashes(part[:-8], part[8:])
        out[at : at + STRETCH] = join_hashes(half[: 16 - GRAM], half[GRAM - 16 :])
    return out


def string_hashes(text: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes at some places of a text."""
    grams = gram_hashes(text)
    out = grams[place]
    for at in [*range(GRAM, length - GRAM, GRAM), length - GRAM]:
        out = join_hashes(out, grams[place + at])
    return out


class Anchors:
    """The anchors of a chunk: place, first string and number of strings of each, and hash."""

    def __init__(self, chunk, length: int):
        n, width = len(chunk.data), length - GRAM + 1
        self.grams = h = gram_hashes(chunk.data)
        key = h * U64(SALTS[0]) & ~LOW | np.arange(len(h), dtype=U64)  # least product first, leftmost on ties; the hashes of anchors stay spread evenly
        got = 1
        while got < width:  # minima over 1, 2, 4 and so on, up to the width
            step = min(got, width - got)
            key = np.minimum(key[:-step], key[step:]) if len(key) > step else key[:0]
            got += step
        owner = key.astype(np.uint32)  # of the string that starts there; an anchor lies in one document
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        new[chunk.bounds[:-1][chunk.bounds[:-1] < len(new)]] = True  # before it are strings that reach into the document
        start = np.flatnonzero(new)
        doc = np.searchsorted(chunk.bounds, start, "right") - 1
        ends = chunk.bounds[1:][doc] - length + 1  # of the document's strings
        inside = start < ends
        self.start, self.doc = start[inside], doc[inside]
        self.count = np.minimum(np.append(start[1:], len(owner)), ends)[inside] - self.start
        self.place = owner[self.start].astype(np.int64)
        self.hash = h[self.place]


def anchors(docs: DataFrame, length: int, parts: int, number: int = 0) -> DataFrame:
    """Packed hashes of all anchors of a batch, with the first string of each as its place."""

    def flush(group: G.Group) -> pa.RecordBatch:
        h, place = (np.concatenate([x[k] for x in group.held]) for k in (0, 1))
        order = np.argsort(h)
        h, place = h[order], place[order]
        cuts = runs(h)
        many = np.diff(cuts)
        one = cuts[:-1]
        again = np.ones(len(h), bool)
        again[one] = False
        alike = (place[again].astype(np.uint32), np.repeat(place[one], many)[again].astype(np.uint32))
        h, place = h[one], place[one] << 1 | (many > 1)  # the lowest bit: this group has it more than once
        data = []
        for p, a, b in G.by_part(part_of(h, parts)):
            low = h[a:b] & LOW
            by = np.argsort(low)
            data.append((p, G.dump(np.diff(low[by], prepend=U64(0)).astype(np.uint32), place[a:b][by].astype(np.uint32))))
        return group.rows(parts, data, None, alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = G.Group(number)
        for chunk in chunks(batches, most=ANCHOR_BYTES):
            if group.size and group.size + len(chunk.data) >= 1 << 30:  # places take 31 bits, with a chunk of 2 GB at most
                yield flush(group)
            a = Anchors(chunk, length)
            bases = group.add(chunk.ids, chunk.rows.column("tag").to_numpy(), np.diff(chunk.bounds))
            group.held.append((a.hash, bases[a.doc] + a.start - chunk.bounds[a.doc]))
            group.weight += len(a.hash)
            if group.weight >= GROUP_ANCHORS:
                yield flush(group)
        if group.size:
            yield flush(group)

    return docs.mapInArrow(run, G.PACKED)


def shared_anchors(rows: DataFrame, number: int | None = None) -> DataFrame:
    """Of each partition, the places of anchors that occur twice, in batch ``number`` if one is told; the count is 1 for common ones, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, out = G.incoming(batches)
        if data:
            unpacked = [G.load(p) for _, p in data]
            h = np.concatenate([np.cumsum(u[0], dtype=np.uint32) for u in unpacked])
            place = np.concatenate([u[1] for u in unpacked])
            grp = np.repeat([g for g, _ in data], [len(u[0]) for u in unpacked])
            del unpacked, data
            order = np.argsort(h)
            cuts = runs(h[order])
            many = np.diff(cuts)
            good = (many > 1) | (np.maximum.reduceat(place[order] & 1, cuts[:-1]) > 0)
            if number is not None:
                good &= np.maximum.reduceat((grp[order] >> G.BATCH_BITS == number).astype(np.int8), cuts[:-1]) > 0
            at = order[np.repeat(good, many)]
            common = np.repeat(many[good] > COMMON, many[good]).astype(np.uint32)
            place >>= np.uint32(1)
            by = np.lexsort((place[at], grp[at]))
            out += G.answers(grp[at][by], place[at][by], common[by])
        yield G.packed(out)

    return rows.mapInArrow(run, G.PACKED)


def contexts(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """Packed contexts of the shared anchors of each document (columns doc_id, tag, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(parts, GROUP_BYTES)
        for chunk in chunks(batches, most=ANCHOR_BYTES):
            if sender.group.size and sender.group.size + len(chunk.data) >= 1 << 30:
                yield sender.flush()
            a = Anchors(chunk, length)
            bases = sender.group.add(chunk.ids, chunk.rows.column("tag").to_numpy(), np.diff(chunk.bounds))
            shared = np.zeros(len(chunk.data) + 1, np.uint8)
            for i, spans in enumerate(chunk.rows.column("spans")):
                start, common = G.load(spans.as_py())
                np.maximum.at(shared, start.astype(np.int64) + chunk.bounds[i], (1 + common).astype(np.uint8))
            kind = shared[a.start]
            plain, common = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
            each = a.count[common]
            single = np.repeat(a.start[common] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            start = np.concatenate([a.start[plain], single])
            count = np.concatenate([a.count[plain], np.ones(len(single), np.int64)])
            doc = np.concatenate([a.doc[plain], np.repeat(a.doc[common], each)])
            size = count + length - 1
            whole = count.astype(U64)
            for at in (start, start + GRAM, start + size - 2 * GRAM, start + size - GRAM):  # these strings cover a context, which is shorter than 4 * GRAM
                whole = join_hashes(whole, a.grams[at])
            # the anchor's place in its context is part of the context's hash
            h = np.concatenate([a.hash[plain], whole[len(plain) :]])
            shift = np.concatenate([a.place[plain] - a.start[plain], np.zeros(len(single), np.int64)])
            yield from sender.send(h, join_hashes(whole, shift.astype(U64)), chunk.ids[doc], bases[doc] + start - chunk.bounds[doc], count, size, chunk.data, start)
        if sender.group.size:
            yield sender.flush()

    return docs.mapInArrow(run, G.PACKED)


@dataclass(frozen=True)
class Level:
    """A suffix array: a text, and places in it in the order of the bytes that begin there."""

    text: np.ndarray
    place: np.ndarray

    def __len__(self) -> int:
        return len(self.place)


class SuffixLevels:
    """A logarithmic family of suffix arrays.

    A level is a text and the places of its suffixes in the order of their first
    ``length`` bytes, of equal ones one. A new batch gets its own suffix array, which is
    merge-scanned against the array of each level: where a batch's suffix stands beside a
    level's, their bytes are compared. It is then the lowest level, and a level less than twice as long
    as the one above it is merged into that, so each suffix is merged a logarithmic number of times.
    Batches come in rising order of id, so what a level holds is from a smaller id.
    """

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []

    def strings(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first bytes of suffixes; a last byte that isn't 0 keeps bytes 0 at the end apart."""
        out = np.empty((len(place), self.length + 1), np.uint8)
        out[:, : self.length] = np.lib.stride_tricks.sliding_window_view(text, self.length)[place]
        out[:, self.length] = 1
        return out.reshape(-1).view(f"S{self.length + 1}")

    def add(self, strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The same for a batch of single strings of ``length`` bytes."""
        text = np.frombuffer(strings.astype(f"S{self.length}").tobytes(), np.uint8)
        return self.add_suffixes(text, np.arange(len(strings)) * self.length, doc)

    def add_suffixes(self, text: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which suffixes (places of ``text``, of documents) a smaller id has, in this batch or before it; then the batch is indexed."""
        if not len(place):
            return np.zeros(0, bool)
        string = self.strings(text, place)
        order = np.argsort(string, kind="stable")
        string = string[order]
        first = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1])))
        size = np.diff(np.append(first, len(order)))
        least = np.minimum.reduceat(doc[order], first)
        distinct, own = string[first], place[order[first]]
        before = np.zeros(len(distinct), bool)
        for level in self.levels:
            before |= self._scan(self.strings(level.text, level.place), distinct)[1]
        covered = np.zeros(len(place), bool)
        covered[order] = np.repeat(before, size) | (doc[order] > np.repeat(least, size))
        self._insert(text, own[~before])
        return covered

    @staticmethod
    def _scan(level: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged order of two sorted runs, the level first on ties, and which of the batch the level has."""
        both = np.concatenate([level, batch])
        order = np.argsort(both, kind="stable")  # of two sorted runs: one merge
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[len(level) :]
        beside = order[np.maximum(at - 1, 0)]
        return order, (at > 0) & (beside < len(level)) & (both[beside] == batch)

    def _insert(self, text: np.ndarray, place: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) < 2 * len(place):
            under = self.levels.pop()
            order, _ = self._scan(self.strings(under.text, under.place), self.strings(text, place))
            place = np.concatenate([under.place, place + len(under.text)])[order]
            text = np.concatenate([under.text, text])
        if len(place):
            self.levels.append(Level(text, place))


def met_strings(heads: Heads, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings (number of the head and of the string in it) whose hash another document's string has: no other string can be repeated."""
    which = np.repeat(np.arange(len(heads.doc)), heads.count)
    string = np.arange(len(which)) - np.repeat(np.cumsum(heads.count) - heads.count, heads.count)
    ends, h = np.cumsum(heads.count), np.empty(len(which), U64)
    for part in slices(heads.size, ANCHOR_BYTES):
        a, b = ends[part.start] - heads.count[part.start], ends[part.stop - 1]
        low, high = heads.begin[part.start], heads.begin[part.stop - 1] + heads.size[part.stop - 1]
        h[a:b] = string_hashes(heads.text[low:high], heads.begin[which[a:b]] + string[a:b] - low, length)
    order = np.argsort(h)
    cuts = runs(h[order])
    doc = heads.doc[which[order]]
    several = np.minimum.reduceat(doc, cuts[:-1]) < np.maximum.reduceat(doc, cuts[:-1])
    met = np.sort(order[np.repeat(several, np.diff(cuts))])
    return which[met], string[met]


def compare_suffixes(heads: Heads, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of heads that a head of a smaller document has, by suffix arrays of batches of rising id.

    The batches are as large as the partition needs for there to be about BATCHES: each is scanned
    against all levels, so that more of them would cost the square of the strings.
    """
    which, string = met_strings(heads, length)
    ids = heads.doc[which]
    rising = np.argsort(ids, kind="stable")
    which, string, ids = which[rising], string[rising], ids[rising]
    found, levels, at, batch = [np.zeros(0, np.int64)], SuffixLevels(length), 0, max(BATCH, -(-len(which) // BATCHES))
    while at < len(which):  # a batch ends with a document, so that earlier batches have smaller ids only
        end = int(np.searchsorted(ids, ids[min(at + batch, len(which)) - 1], "right"))
        own, index = np.unique(which[at:end], return_inverse=True)
        size = heads.size[own]
        begin = np.cumsum(size) - size
        hit = levels.add_suffixes(gather_bytes(heads.text, heads.begin[own], size), begin[index] + string[at:end], ids[at:end])
        found.append(at + np.flatnonzero(hit))
        at = end
    hits = np.concatenate(found)
    return which[hits], string[hits]


def spans_of(texts: DataFrame, rows: DataFrame, length: int, parts: int, number: int | None = None, copies: DataFrame | None = None) -> DataFrame:
    """Spans of string starts that a smaller id has too, from the packed anchors of documents (columns doc_id, tag, text).

    ``copies`` are documents to leave out: each string of theirs is in a document of smaller id that is searched.
    """
    found = G.per_document(shared_anchors(G.deal(rows, parts), number), parts)
    if copies is not None:
        found = found.join(copies.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti")
    hit = materialise(found, "anchors")
    near = contexts(texts.join(hit, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans"), length, parts)
    out = materialise(G.per_document(covered(G.deal(near, parts), lambda heads: compare_suffixes(heads, length)), parts), "repeats")
    discard(hit)
    return out


def searched(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text and tag of the rows that can hold repeats."""
    return G.keyed(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))


def later_copies(own: DataFrame, length: int) -> DataFrame:
    """doc_id, tag and spans of the searched rows whose whole text a smaller id has: all their strings are repeats."""
    texts = own.select("doc_id", "tag", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"))
    least = texts.groupBy("digest").agg(F.min("doc_id").alias("least"))
    later = texts.join(least, "digest").where("doc_id > least").select("doc_id", "tag", "size").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("size").to_numpy() - length + 1
            spans = [G.dump(np.zeros(1, np.uint32), count[k : k + 1].astype(np.uint32)) for k in range(len(count))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(spans, pa.binary())], ["doc_id", "tag", "spans"])

    return materialise(later.mapInArrow(run, G.SPANS), "copies")


def repeated_strings(docs: DataFrame, length: int = 50) -> DataFrame:
    """Spans of string starts that a document with a smaller id has too: doc_id, tag, spans."""
    parts = partitions(docs.sparkSession)
    own = searched(docs, length)
    copies = later_copies(own, length)
    return spans_of(own, anchors(own, length, parts), length, parts, copies=copies).unionByName(copies)


class SuffixFamily:
    """A logarithmic family of indexes over batches of documents, kept as tables of the shared folder.

    A batch's index is its anchors, packed by hash partition in order of their hashes, and its texts. A new batch is
    scanned against the indexes of all levels; what it shares with them is compared by
    suffix arrays in each partition, as within a batch. It is then the lowest level, and a
    level of less than twice as many documents as the one above it is merged into that: so there are
    at most a logarithmic number of levels, and a document is merged that many times. Batches come in
    rising order of id; earlier batches are never searched for their own repeats again.
    """

    def __init__(self, spark, length: int = 50, parts: int | None = None):
        self.length, self.parts = length, parts or partitions(spark)
        self.levels: list[tuple[DataFrame, DataFrame, int]] = []  # packed anchors, texts, and documents
        self.batches, self.last = 0, None

    def add(self, docs: DataFrame) -> DataFrame:
        """Per document of the batch: bytes, removed bytes and runs, and SHA-256 of what is kept; then the batch is indexed."""
        own = materialise(searched(docs, self.length), "batch")
        n, least, most = own.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
        if not n:
            return described(docs, own.select("doc_id", "tag", F.lit(None).cast("binary").alias("spans")), self.length)
        if self.last is not None and least <= self.last:
            raise ValueError(f"id {least} is not above {self.last}, the largest of earlier batches")
        fresh = materialise(anchors(own, self.length, self.parts, self.batches), "level-anchors")
        rows, texts = fresh, own
        for packed, there, _ in self.levels:
            rows, texts = rows.unionByName(packed), texts.unionByName(there)
        spans = spans_of(texts, rows, self.length, self.parts, self.batches).where(F.col("doc_id") >= least)
        self.batches, self.last = self.batches + 1, most
        self._insert(fresh, own, n)
        return described(docs, spans, self.length)

    def _insert(self, packed: DataFrame, texts: DataFrame, n: int) -> None:
        while self.levels and self.levels[-1][2] < 2 * n:
            above, there, many = self.levels.pop()
            merged = materialise(above.unionByName(packed).repartition(self.parts, "part").sortWithinPartitions("part", "kind", "grp"), "level-anchors")
            both = materialise(there.unionByName(texts), "batch")
            discard(above, there, packed, texts)
            packed, texts, n = merged, both, n + many
        self.levels.append((packed, texts, n))


def removed(text: bytes, spans: bytes | None, length: int) -> np.ndarray | None:
    """Which bytes go; None if none."""
    if spans is None or not text:
        return None
    start, count = G.load(spans)
    return spread(start, count + np.uint32(length - 1), 0, len(text))


def drop_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per document: bytes, removed bytes and runs, and SHA-256 of what is kept."""
    return described(docs, repeated_strings(docs, length), length)


def described(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """What ``drop_repeats`` tells of each document, from its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for value, found in zip(part.column("text").cast(pa.large_binary()), part.column("spans"), strict=True):
                    text = value.as_py() or b""
                    gone = removed(text, found.as_py(), length)
                    if gone is None:
                        rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                        continue
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((len(text), len(text) - len(kept), edges, hashlib.sha256(kept).hexdigest()))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return G.keyed(docs).join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(run, RESULT)


def cut_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of ``docs`` without repeated strings; ``n_chars``, where there, is the new length.

    A character of which a byte goes is gone as a whole, so that texts stay UTF-8.
    """
    spans = repeated_strings(docs, length)
    keys = {"__rf_doc": F.col("doc_id").cast("long"), "__rf_tag": F.xxhash64(F.col("text").cast("string"))}
    joined = docs.withColumns(keys).join(spans.select(F.col("doc_id").alias("__rf_doc"), F.col("tag").alias("__rf_tag"), F.col("spans").alias("__rf_spans")), ["__rf_doc", "__rf_tag"], "left").drop("__rf_doc", "__rf_tag")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                i, texts, sizes = part.schema.get_field_index("text"), [], []
                for value, found in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("__rf_spans").to_pylist(), strict=True):
                    gone = removed(value, found, length) if value else None
                    if gone is not None:
                        value = np.frombuffer(value, np.uint8)[~gone].tobytes().decode(errors="ignore").encode()
                    texts.append(value)
                out = part.drop_columns(["__rf_spans"])
                out = out.set_column(i, out.schema.field(i), pa.array(texts, pa.large_binary()).cast(out.schema.field(i).type))
                if (k := out.schema.get_field_index("n_chars")) >= 0:
                    sizes = [None if t is None else len(t.decode()) for t in texts]
                    out = out.set_column(k, out.schema.field(k), pa.array(sizes, out.schema.field(k).type))
                yield out

    return joined.mapInArrow(run, schema)
