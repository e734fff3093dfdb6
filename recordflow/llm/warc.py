"""Operator 10: WARC archives and a merged capture index.

Pages are written as WARC records into archives of bounded size, kept in a table
of the shared folder. Of records with equal payloads one is the response; the
others are revisits that carry its headers only. Reading the archives back yields,
for each archive, a run of index lines sorted by URL key and time. The external
merge deals the lines by range of URL key, time, page and place, in ranges of about ``RANGE_ROWS``
lines, so that no URL is a range of its own; each task gets its part of each run in order,
from a sort that spills, and a tournament tree of losers merges these, so that the whole index is in order
and the captures of a URL stand together.

Defined results: a null payload is empty; a null URL is the empty string; payloads
below ``least`` bytes are never revisits; a page without an id is a response, is never referred to and comes first
among equal times; equal times are ordered by page_id;
repeated rows are further captures; a very long payload is an archive of its own, held whole by a task; other columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import light_batches, materialise, partitions

FEED = 1 << 16  # bytes of an archive that are unpacked at once
RANGE_ROWS = 100_000  # index lines of a range, about
ARCHIVE_BYTES = 4 << 20  # of payload in an archive; a larger payload is one of its own
EPOCH = 1_700_000_000  # a page without a time of capture was fetched page_id modulo 10**9 seconds later
ARCHIVES = "archive string, data binary"
INDEX = "urlkey string, captured long, page_id long, archive string, offset long, size long, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


class LoserTree:
    """Merges k sorted iterators: each inner node keeps the loser of its match.

    After the smallest item is taken, only the matches between its leaf and the
    root are played again.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.head = [next(r, None) for r in runs]
        self.k = k = max(1, len(runs))
        winner = list(range(k, 2 * k))
        self.loser = [0] * k
        up = [0] * k + [x - k for x in winner]
        for node in range(k - 1, 0, -1):
            a, b = up[2 * node], up[2 * node + 1]
            up[node], self.loser[node] = (b, a) if self._before(b, a) else (a, b)
        self.first = up[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self) -> Iterator[tuple]:
        if not self.runs:
            return
        while (item := self.head[self.first]) is not None:
            yield item
            at = self.first
            self.head[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._before(self.loser[node], at):
                    at, self.loser[node] = self.loser[node], at
                node //= 2
            self.first = at


def url_key(url: str) -> str:
    """Sortable key of a URL: host labels from the right, then path and query, in lower case; no scheme, www, port 80/443 or fragment."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def write_record(page_id: int, url: str, captured: int, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a WARC record; a revisit has the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        f"WARC-Date: {datetime.datetime.fromtimestamp(captured, datetime.UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def read_records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, stored size, header and block of each record of an archive."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof and end < len(archive):
            parts.append(member.decompress(view[end : end + FEED]))
            end = min(end + FEED, len(archive))
        if not member.eof:
            raise ValueError(f"the record at {at} breaks off")
        raw, size = b"".join(parts), end - at - len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield at, size, fields, rest[: int(fields["Content-Length"])]
        at += size


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives of the pages (page_id, url, captured, html, refers_to); tasks cut them at ``ARCHIVE_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full() -> pa.RecordBatch:
            nonlocal n, held, size
            out = pa.RecordBatch.from_arrays([pa.array([f"captures-{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])
            n, held, size = n + 1, [], 0
            return out

        for batch in batches:
            for at in range(batch.num_rows):
                page, url, captured, html, refers = (batch.column(c)[at].as_py() for c in ("page_id", "url", "captured", "html", "refers_to"))
                held.append(write_record(page, url or "", captured, html or b"", refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield full()
        if held:
            yield full()

    return pages.mapInArrow(run, ARCHIVES)


def read_index(archives: DataFrame) -> DataFrame:
    """Index lines of the archives, each archive's sorted by URL key, time and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive"), batch.column("data"), strict=True):
                rows = []
                for at, size, head, block in read_records(data.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if head["WARC-Type"] == "response" and (digest(payload) != told or len(payload) != length):
                        raise ValueError(f"{name}: the payload at {at} is damaged")
                    when = datetime.datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC)
                    refers = head.get("X-Refers-To-Page-ID")
                    rows.append((url_key(head["WARC-Target-URI"]), int(when.timestamp()), int(head["X-Page-ID"]) if head["X-Page-ID"] else None, name.as_py(), at, size, length, told, head["WARC-Type"], int(refers) if refers else None))
                rows.sort(key=_order)
                yield _index_batch(rows)

    return archives.mapInArrow(run, INDEX)


def _index_batch(rows: list[tuple], extra: tuple = ()) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in INDEX_NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, INDEX_TYPES, strict=False)] + [pa.array(c, pa.int64()) for c in columns[len(INDEX_TYPES) :]], [*INDEX_NAMES, *extra])


def _runs(batches: Iterable[pa.RecordBatch]) -> list[Iterator[tuple]]:
    """The lines of each archive, which come one archive after the other, each in order."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    for batch in batches:
        names = batch.column("archive").dictionary_encode()
        code = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)] if len(code) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            runs.setdefault(names.dictionary[code[a]].as_py(), []).append(batch.slice(a, b - a))
    return [map(_keyed, _lines(held)) for _, held in sorted(runs.items())]


def _lines(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(batch.slice(at, 256).column(c).to_pylist() for c in INDEX_NAMES), strict=True)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def _keyed(row: tuple) -> tuple:
    return _order(row), row


def merge_index(index: DataFrame, parts: int) -> DataFrame:
    """The index in order of URL key and time over the whole result, by partition and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, row in LoserTree(_runs(batches)):
            rows.append(row)
            if len(rows) == 4096:
                yield _index_batch(rows)
                rows = []
        if rows:
            yield _index_batch(rows)

    order = ["urlkey", "captured", "page_id", "archive", "offset"]  # no two lines are equal in these
    return index.repartitionByRange(parts, *order).sortWithinPartitions("archive", "urlkey", "captured", "page_id", "offset").mapInArrow(run, INDEX)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with ``refers_to``: the largest page_id of those with the same payload of at least ``least`` bytes, null for that page itself.

    Only ids and digests meet by digest; pages meet what is told of them by id.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    captured = F.col("captured").cast("long") if "captured" in pages.columns else F.lit(EPOCH) + F.coalesce(F.expr("pmod(cast(page_id as bigint), 1000000000)"), F.lit(0))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), captured.alias("captured"), html.alias("html"))
    digests = own.where(F.col("page_id").isNotNull() & (F.length("html") >= least)).select("page_id", F.sha1("html").alias("sha1"))
    last = digests.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first")).where("refers_to > first").drop("first")
    again = digests.join(last, "sha1").where("page_id < refers_to").distinct()
    named = own.where("page_id is not null").withColumn("sha1", F.sha1("html")).join(again, ["page_id", "sha1"], "left")
    columns = ["page_id", "url", "captured", "html", "refers_to"]
    return named.select(columns).unionByName(own.where("page_id is null").withColumn("refers_to", F.lit(None).cast("long")).select(columns))


def capture_index(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives of the pages, read them back, and merge their indexes."""
    spark = pages.sparkSession
    light_batches(spark)
    archives = materialise(write_archives(with_revisits(pages, least)), "archives")
    index = materialise(read_index(archives), "index")
    return merge_index(index, max(partitions(spark), -(-index.count() // RANGE_ROWS)))
