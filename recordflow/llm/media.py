"""Operator 8: media columns over ISO media containers.

``write_media`` stores a payload losslessly as 8-bit samples in a container of
nested boxes; ``read_media`` walks the boxes of any such container, decodes its
sample tables and gives codec, duration and the byte ranges of key samples
without touching the samples; ``stored_payload`` reads the samples back.

Defined results: null and empty texts store one block of 64 zero bytes; a
container that breaks off, lacks a table, nests boxes more than ``DEPTH`` deep, or whose tables claim more
than the container holds has the error in ``media_error`` and nulls
elsewhere, and never stops the job; so has one of movie fragments, which are not decoded.
Nothing is built that is larger than a container's bytes allow for. Repeated rows give repeated
results; a very long text is one container, held whole by a task; other columns are ignored; equal payloads
give equal containers (no time of writing is stored); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view

DEPTH = 32  # of nested boxes
BLOCK = 64  # payloads are padded to a multiple of this
SAMPLE_BYTES = 1024
SAMPLES_PER_CHUNK = 16  # the first sample of each chunk is a key sample
TIMESCALE = 8000  # one byte is one tick
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
COLUMNS = "media_error string, codec string, duration_ticks long, timescale long, n_samples long, key_ranges array<struct<start:long,end:long>>"


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


def pad(payload: bytes) -> bytes:
    """The payload with bytes 0 up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % BLOCK or (0 if payload else BLOCK))


def write_media(payload: bytes) -> bytes:
    """A container with one track of 8-bit samples: ftyp, moov with its tables, mdat."""
    sizes = [min(SAMPLE_BYTES, len(payload) - at) for at in range(0, len(payload), SAMPLE_BYTES)]
    n = len(sizes)
    per_chunk = [min(SAMPLES_PER_CHUNK, n - at) for at in range(0, n, SAMPLES_PER_CHUNK)]
    wide = len(payload) >= 1 << 31
    spans = [(i + 1, k) for i, k in enumerate(per_chunk) if not i or k != per_chunk[i - 1]]
    ticks = [(len(list(g)), size) for size, g in itertools.groupby(sizes)]

    def moov(first: int) -> bytes:
        at = [first + i * SAMPLES_PER_CHUNK * SAMPLE_BYTES for i in range(len(per_chunk))]
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        tables = [
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">I", len(ticks)), *(struct.pack(">II", c, d) for c, d in ticks)),
            full(b"stss", struct.pack(">I", len(per_chunk)), *(struct.pack(">I", 1 + i * SAMPLES_PER_CHUNK) for i in range(len(per_chunk)))),
            full(b"stsc", struct.pack(">I", len(spans)), *(struct.pack(">III", i, k, 1) for i, k in spans)),
            full(b"stsz", struct.pack(">II", 0, n), struct.pack(f">{n}I", *sizes)),
            full(b"co64", struct.pack(">I", len(at)), struct.pack(f">{len(at)}Q", *at)) if wide else full(b"stco", struct.pack(">I", len(at)), struct.pack(f">{len(at)}I", *at)),
        ]
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, len(payload), 0x55C4, 0), version=1),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), box(b"stbl", *tables)),
        )
        header = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, len(payload), 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        track = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        return box(b"moov", header, box(b"trak", track, media))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")
    mdat = box(b"mdat", payload)
    first = len(head) + len(moov(0)) + len(mdat) - len(payload)
    return head + moov(first) + mdat


def entries(table: bytes, kind: str, at: int = 4) -> np.ndarray:
    """The counted entries of a table; the count must not claim more than the table holds."""
    n = struct.unpack_from(">I", table, at)[0]
    kind = np.dtype(kind)
    if at + 4 + n * kind.itemsize > len(table):
        raise ValueError(f"a table of {len(table)} bytes claims {n} entries")
    return np.frombuffer(table, kind, n, at + 4)


@dataclass
class Track:
    size: int  # of the container
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, bytes] = field(default_factory=dict)

    def sizes(self) -> np.ndarray:
        """The size of each sample."""
        if b"stz2" in self.tables:
            table = self.tables[b"stz2"]
            bits, n = table[7], struct.unpack_from(">I", table, 8)[0]
            if bits not in (4, 8, 16) or 12 + -(-n * bits // 8) > len(table):
                raise ValueError(f"a table of {len(table)} bytes claims {n} sizes of {bits} bits")
            if bits == 4:
                pairs = np.frombuffer(table, np.uint8, -(-n // 2), 12)
                return np.column_stack([pairs >> 4, pairs & 15]).ravel()[:n].astype(np.int64)
            return np.frombuffer(table, f">u{bits // 8}", n, 12).astype(np.int64)
        fixed, n = struct.unpack_from(">II", self.tables[b"stsz"], 4)
        if not fixed:
            return entries(self.tables[b"stsz"], ">u4", 8).astype(np.int64)
        if n * fixed > self.size:
            raise ValueError(f"{n} samples of {fixed} bytes in {self.size} bytes")
        return np.full(n, fixed, np.int64)

    def samples(self) -> list[tuple[int, int]]:
        """Start and end of each sample's bytes in the container."""
        sizes = self.sizes()
        starts = entries(self.tables[b"co64"], ">u8") if b"co64" in self.tables else entries(self.tables[b"stco"], ">u4")
        starts, spans = starts.astype(np.int64), entries(self.tables[b"stsc"], ">u4,>u4,>u4")
        first, per = spans["f0"].astype(np.int64), spans["f1"].astype(np.int64)
        chunks = np.diff(np.append(first, len(starts) + 1))
        if len(first) and (first[0] != 1 or (chunks < 0).any()) or (chunks * per).sum() != len(sizes) or not len(first) and len(sizes):
            raise ValueError(f"{len(starts)} chunks do not hold {len(sizes)} samples")
        many = np.repeat(per, chunks)  # samples of each chunk
        ends = np.cumsum(sizes)
        before = np.concatenate(([0], ends))[np.cumsum(many) - many]  # bytes of samples before each chunk
        end = np.repeat(starts - before, many) + ends
        if len(end) and (end.max() > self.size or (end - sizes).min() < 0):
            raise ValueError("a sample lies outside of the container")
        return list(zip((end - sizes).tolist(), end.tolist(), strict=True))

    def keys(self) -> list[int]:
        """Key samples, from 0; without a table of them each sample is one."""
        n, table = len(self.sizes()), self.tables.get(b"stss")
        if table is None:
            return list(range(n))
        keys = entries(table, ">u4").astype(np.int64)
        if len(keys) and (keys.min() < 1 or keys.max() > n):
            raise ValueError("a key sample that is not there")
        return (keys - 1).tolist()


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The boxes between two places: kind, and start and end of the content."""
    while start < end:
        if end - start < 8:
            raise ValueError(f"a box breaks off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} is {size} bytes long")
        yield kind, start + head, start + size
        start += size


def read_media(data: bytes) -> list[Track]:
    """The tracks of a container; the samples themselves are not read."""
    view, tracks = memoryview(data), []
    open_boxes = [walk(view, 0, len(data))]
    while open_boxes:
        found = next(open_boxes[-1], None)
        if found is None:
            open_boxes.pop()
            continue
        kind, a, b = found
        if kind == b"moof":
            raise ValueError("movie fragments are not decoded")
        if kind == b"trak":
            tracks.append(Track(len(data)))
        if kind in NESTED:
            if len(open_boxes) == DEPTH:
                raise ValueError(f"boxes nest more than {DEPTH} deep")
            open_boxes.append(walk(view, a, b))
        elif tracks and kind == b"mdhd" and b > a:
            tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ", view[a:b], 20) if view[a] else struct.unpack_from(">II", view[a:b], 12)
        elif tracks and kind[:3] in (b"sts", b"stc", b"stt", b"stz", b"co6"):
            tracks[-1].tables[kind] = bytes(view[a:b])
            if kind == b"stsd":
                tracks[-1].codec = bytes(view[a + 12 : min(a + 16, b)]).decode("latin-1")
    if not tracks:
        raise ValueError("no track")
    return tracks


def stored_payload(data: bytes) -> bytes:
    """The samples of the first track, end to end."""
    return b"".join(data[a:b] for a, b in read_media(data)[0].samples())


def media_columns(df: DataFrame, media: str, id_name: str) -> DataFrame:
    """Codec, duration and key ranges of the containers in a binary column, beside ``id_name``."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                try:
                    track = read_media(value.as_py() or b"")[0]
                    spans = track.samples()
                    rows.append((None, track.codec, track.duration, track.timescale, len(spans), [{"start": spans[k][0], "end": spans[k][1]} for k in track.keys()]))
                except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
                    rows.append((f"{type(e).__name__}: {e}", None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["id", *names])

    return df.select(F.col(id_name).cast("long").alias("id"), F.col(media).alias("media")).mapInArrow(run, f"id long, {COLUMNS}").withColumnRenamed("id", id_name)


def feature(data: bytes) -> str:
    """What the tables say of a container, as text."""
    track = read_media(data)[0]
    spans, keys = track.samples(), track.keys()
    first, last = spans[keys[0]], spans[keys[-1]]
    return f"codec={track.codec.strip()};timescale={track.timescale};ticks={track.duration};samples={len(spans)};keys={len(keys)};first_key={first[0]}-{first[1]};last_key={last[0]}-{last[1]}"


def store_documents(docs: DataFrame) -> DataFrame:
    """Store each text in a container, read it back, and describe both."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text in part.column("text").cast(pa.large_binary()):
                    raw = text.as_py() or b""
                    media = write_media(pad(raw))
                    back = stored_payload(media)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(media)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    return documents_view(docs).mapInArrow(run, SCHEMA)
