"""Operator 2: removal of repeated word windows by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window. A
window of ``window`` words that occurs twice holds a whole reference block of each
of its documents, so probing the index of blocks with every rolling window of block
length meets every repeat. Each hit is extended over the words around it, as far as a
window with the block can reach: there words are compared, and runs of windows that an earlier
document has too are the maximal repeats that go.

1. Blocks and probes are dealt by hash; hits are places whose hash a reference block
   shares. A hash that one group of documents holds often is sent once, so a passage
   that many documents share loads no partition.
2. Each hit sends its context: the words of all windows that hold the block. A block that very many groups
   of documents hold sends each window as a context of its own, dealt by its own hash,
   so no block gathers in one task. Equal contexts, and windows of the others, are told by their bytes.
3. Documents drop the covered words.

Defined results: null and empty texts have no words; a document without an id is
no source and keeps all its words, as do documents shorter than a window; documents
of equal id never remove each other's words; repeated rows give repeated results; very long
texts are handled whole, one at a time; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups as G
from .common import SALTS, U64, Words, chunks, discard, join_hashes, materialise, part_of, partitions, runs, span_hashes, window_hash
from .contexts import GROUP_BYTES, Heads, Sender, covered, equal_contexts

GROUP_WORDS = 2_000_000  # words of a group of documents
COMMON = 2000  # a block that more groups of documents hold sends single windows
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
LOW = U64(0xFFFFFFFF)


def probes(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Packed hashes of all rolling windows of block length, each once for a group.

    The lowest bits of a place tell whether one of them is a reference block, and whether
    the group has it more than once.
    """
    block = window // 2

    def flush(group: G.Group) -> pa.RecordBatch:
        h, place = (np.concatenate([x[k] for x in group.held]) for k in (0, 1))
        order = np.argsort(h)
        h, place = h[order], place[order]
        cuts = runs(h)
        one, many = cuts[:-1], np.diff(cuts)
        again = np.ones(len(h), bool)
        again[one] = False
        start = place >> 1
        alike = (start[again].astype(np.uint32), np.repeat(start[one], many)[again].astype(np.uint32))
        reference = np.maximum.reduceat(place & 1, one) if len(one) else one
        h, place = h[one], start[one] << 2 | reference << 1 | (many > 1)
        data = []
        for p, a, b in G.by_part(part_of(h, parts)):
            low = h[a:b] & LOW
            by = np.argsort(low)
            data.append((p, G.dump(np.diff(low[by], prepend=U64(0)).astype(np.uint32), place[a:b][by].astype(np.uint64))))
        return group.rows(parts, data, None, alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = G.Group()
        for chunk in chunks(batches):
            w = Words(chunk)
            many = np.diff(w.docs)
            bases = group.add(chunk.ids, chunk.rows.column("tag").to_numpy(), many)
            doc = w.doc_of()
            at = w.windows(block)
            at = at[many[doc[at]] >= window]
            h = window_hash(w.hash, block)[at]
            inside = at - w.docs[doc[at]]
            group.held.append((h, (bases[doc[at]] + inside) << 1 | (inside % block == 0)))
            if group.size >= GROUP_WORDS:
                yield flush(group)
        if group.size:
            yield flush(group)

    return docs.mapInArrow(run, G.PACKED)


def hits(rows: DataFrame) -> DataFrame:
    """Of each partition, the places whose hash a reference block shares; the count is 1 for common blocks, else 0."""

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
            bits = np.bitwise_or.reduceat(place[order] & U64(3), cuts[:-1])
            good = (bits >= 2) & ((many > 1) | (bits == 3))
            at = order[np.repeat(good, many)]
            common = np.repeat(many[good] > COMMON, many[good]).astype(np.uint32)
            start = (place[at] >> U64(2)).astype(np.uint32)
            by = np.lexsort((start, grp[at]))
            out += G.answers(grp[at][by], start[by], common[by])
        yield G.packed(out)

    return rows.mapInArrow(run, G.PACKED)


def spread(starts: np.ndarray, counts: np.ndarray, before: int, n: int) -> np.ndarray:
    """Mark of 0..n-1 the places of spans that begin ``before`` earlier."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts.astype(np.int64) - before, 0, n), 1)
    np.add.at(edge, np.clip(starts.astype(np.int64) + counts.astype(np.int64), 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def contexts(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Packed contexts of the hits of each document (columns doc_id, tag, text, spans): their words, with a space after each."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(parts, GROUP_BYTES)
        for chunk in chunks(batches):
            w = Words(chunk)
            bases = sender.group.add(chunk.ids, chunk.rows.column("tag").to_numpy(), np.diff(w.docs))
            found = [G.load(spans.as_py()) for spans in chunk.rows.column("spans")]
            of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            place = np.concatenate([f[0] for f in found]).astype(np.int64) + w.docs[of]
            common = np.concatenate([f[1] for f in found]) > 0
            left = np.maximum(w.docs[of], place - (block - 1))  # the first word of the first window that the block may begin a reference of
            right = np.minimum(w.docs[of + 1], place + window)
            wide = right - left >= window
            at = np.flatnonzero(wide & ~common)
            many = (right - left - window + 1)[some := np.flatnonzero(wide & common)]
            single = np.unique(np.repeat(left[some] - (np.cumsum(many) - many), many) + np.arange(int(many.sum())))
            whole, checks = window_hash(w.hash, window), window_hash(w.check, window)
            first, last = np.concatenate([left[at], single]), np.concatenate([right[at], single + window])
            doc = np.searchsorted(w.docs, first, "right") - 1
            anchor = np.concatenate([window_hash(w.hash, block)[place[at]], whole[single]])
            check = join_hashes(join_hashes(checks[first], checks[last - window]), np.concatenate([place[at] - left[at], np.zeros(len(single), np.int64)]).astype(U64))
            size = w.end - w.start + 1
            ends = np.concatenate(([0], np.cumsum(size)))
            text = np.full(int(ends[-1]), 32, np.uint8)
            letter = np.ones(len(text), bool)
            letter[ends[1:] - 1] = False
            text[letter] = w.letters()
            yield from sender.send(anchor, check, chunk.ids[doc], bases[doc] + first - w.docs[doc], last - first - window + 1, ends[last] - ends[first], text, ends[first])
        if sender.group.size:
            yield sender.flush()

    return docs.mapInArrow(run, G.PACKED)


def compare_windows(heads: Heads, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of heads that a head of a smaller document with the same block has, word for word."""
    ends = np.concatenate(([0], np.flatnonzero(heads.text == 32) + 1))
    first = np.searchsorted(ends, heads.begin)  # word of each head
    h = window_hash(span_hashes(heads.text, ends[:-1], np.diff(ends), SALTS[0]), window)
    which = np.repeat(np.arange(len(first)), heads.count)
    string = np.arange(len(which)) - np.repeat(np.cumsum(heads.count) - heads.count, heads.count)
    at = first[which] + string
    order, runs_at = equal_contexts(heads.anchor[which], h[at], heads.doc[which], heads.text, ends[at], ends[at + window] - ends[at])
    doc = heads.doc[which][order]
    hit = order[doc > np.repeat(doc[runs_at], np.diff(np.append(runs_at, len(order))))]
    return which[hit], string[hit]


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """Spans of window starts that a document with a smaller id has too: doc_id, tag, spans."""
    parts = partitions(docs.sparkSession)
    own = G.keyed(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * window - 1))
    hit = materialise(G.per_document(hits(G.deal(probes(own, window, parts), parts)), parts), "block-hits")
    near = contexts(own.join(hit, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans"), window, parts)
    out = materialise(G.per_document(covered(G.deal(near, parts), lambda heads: compare_windows(heads, window)), parts), "block-repeats")
    discard(hit)
    return out


def kept_words(text: bytes, spans: bytes | None, window: int) -> tuple[int, list[bytes]]:
    """How many words a text has, and those that no repeated window covers."""
    words = text.split()  # at 0x20 and 0x09-0x0D
    if spans is None or not words:
        return len(words), words
    start, count = G.load(spans)
    gone = spread(start, count + np.uint32(window - 1), 0, len(words))
    return len(words), [words[i] for i in np.flatnonzero(~gone)]


def drop_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per document: words, removed words, and SHA-256 of what is kept."""
    spans = repeated_windows(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text, gone in zip(part.column("text").cast(pa.large_binary()), part.column("spans"), strict=True):
                    n, kept = kept_words(text.as_py() or b"", gone.as_py(), window)
                    rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return G.keyed(docs).join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(run, RESULT)
