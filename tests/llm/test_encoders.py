"""Packing, byte-level BPE, media containers and WARC against the libraries, round trips and brute force."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from recordflow.llm import byte_bpe, media, packing, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = list("ab ZéÉßñ.,!\n\t\r\x1c\x1f\x85\xa0　漢字'12\U0001f600́\x00İ÷ªµ¡«~`{|}[]\\^_@Σ") + ["'s", "'ll", "<|endoftext|>", "  ", "tion", " the"]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 16))) for _ in range(n)]


@pytest.fixture(scope="module")
def words():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def test_word_tokenizer(words):
    own = packing.WordTokenizer(WORDS)
    r = random.Random(2)
    texts = odd_texts(4000, 1) + ["".join(r.choice("etaoinshrdlucmféèñß") for _ in range(r.randint(1, 30))) + r.choice(["", ".", "!!", "'s"]) for _ in range(4000)]
    for text, e in zip(texts, words.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == e.ids, repr(text)


def test_byte_codec():
    own = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in [*odd_texts(6000, 3), "", "x" * 5000, " " * 300]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0, b"b": 2})


def test_encode_documents(docs, texts, no_docs):
    got = Counter(tuple(r) for r in byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect())
    ranks = byte_bpe.read_ranks(RANKS)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in texts:
        ids = theirs.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert byte_bpe.encode_documents(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def check_packing(rows, texts, words, most):
    want = Counter()
    for i, t in texts:
        ids = [*words.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), most)):
            q = ids[a : a + most]
            want[(i, p, a, len(q), zlib.crc32(np.array(q, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= most
    return bins


def test_pack(docs, texts, words, no_docs):
    bins = check_packing(packing.pack(docs, packing.word_encoder(WORDS)).collect(), texts, words, 4096)
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= -(-total // 4096) + 1
    small = packing.Capacity(tokens=64, documents=3, attention=2500, weights=(1.0, 0.5, 0.5), by="dot")
    with pytest.raises(ValueError):  # a full piece of 64 tokens costs more attention than a bin has
        packing.pack(docs, packing.word_encoder(WORDS), capacity=small)
    assert packing.pack(no_docs, packing.word_encoder(WORDS)).collect() == []


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_vector_capacities(by):
    r = random.Random(1)
    counts = {n: r.randint(0, 40) for n in range(1, 65)}
    capacity = packing.Capacity(tokens=64, documents=5, attention=64 * 64, weights=(1.0, 0.3, 0.3), by=by)
    plan = packing.Plan({n: c for n, c in counts.items() if c}, capacity)
    bins = {}
    for n, c in counts.items():
        sequence, offset = plan.place(np.full(c, n), np.arange(c))
        for s, o in zip(sequence, offset, strict=True):
            bins.setdefault(int(s), []).append((int(o), n))
    assert sum(map(len, bins.values())) == sum(counts.values()) and len(bins) == plan.sequences
    for pieces in bins.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0
        assert len(pieces) <= 5 and sum(n for _, n in pieces) <= 64 and sum(n * n for _, n in pieces) <= 64 * 64
    assert plan.sequences <= 1.25 * max(sum(n * c for n, c in counts.items()) / 64, sum(counts.values()) / 5)


def test_best_fit_like_one_by_one():
    """The plan over counts gives as few bins as placing pieces one at a time."""
    r = random.Random(8)
    for _ in range(20):
        pieces = [r.randint(1, 100) for _ in range(r.randint(0, 300))]
        left = []
        for n in sorted(pieces, reverse=True):
            fit = [k for k, x in enumerate(left) if x >= n]
            if fit:
                left[min(fit, key=lambda k: left[k])] -= n
            else:
                left.append(100 - n)
        assert packing.Plan(Counter(pieces), packing.Capacity(100, 10**6, 10**9, (1.0, 0.0, 0.0))).sequences == len(left)


def test_store_documents(docs, texts, no_docs):
    rows = media.store_documents(docs).collect()
    want = Counter()
    for i, t in texts:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r["payload_sha256"], tuple(r)[5:]) == tuple(r)[5:]
    assert media.store_documents(no_docs).collect() == []


@pytest.mark.parametrize("n", [64, 1024, 1088, 16 * 1024, 16 * 1024 + 64, 70_016])
def test_container(n):
    payload = os.urandom(n)
    data = media.write_media(payload)
    assert media.stored_payload(data) == payload
    (track,) = media.read_media(data)
    assert (track.codec, track.timescale, track.duration) == ("raw ", 8000, n)
    spans = track.samples()
    assert spans[0][0] == len(data) - n and spans[-1][1] == len(data) and track.keys() == list(range(0, len(spans), 16))


def test_damaged_containers(spark):
    good = media.write_media(bytes(128))
    cut = good[:-200]
    wide = struct.pack(">I", 1) + b"free" + struct.pack(">Q", 24) + bytes(8) + good[:0]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(cut)), (3, None), (4, bytearray(b"short")), (5, bytearray(wide))], "page_id long, media binary")
    got = {r["page_id"]: r for r in media.media_columns(df, "media", "page_id").collect()}
    assert got[1]["codec"] == "raw " and got[1]["duration_ticks"] == 128 and got[1]["media_error"] is None
    assert got[1]["key_ranges"][0]["end"] - got[1]["key_ranges"][0]["start"] == 128
    assert all(got[k]["media_error"] and got[k]["codec"] is None for k in (2, 3, 4, 5))


def test_loser_tree():
    r = random.Random(4)
    for k in range(9):
        runs = [sorted((r.randint(0, 20),) for _ in range(r.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


PAGES = "page_id long, url string, html string, archive string, offset long, sha1 string"


def test_warc(spark):
    r = random.Random(6)
    pages = [(i, r.choice([f"http://www.a{r.randint(0, 3)}.example.com/p?x={r.randint(0, 2)}#f", "https://b.example.org:443/Q", None, "not a url\r\nX: y", "http://[bad"]), r.choice([f"<p>{r.randint(0, 9)}</p>", "", None, "é" * 3000]), "a", 1, "s") for i in range(300)]
    pages.append((None, "http://a0.example.com/", "<p>none</p>", "a", 1, "s"))
    df = spark.createDataFrame(pages, PAGES).repartition(7)
    rows = warc.capture_index(df).collect()
    last = {}
    for i, _, h, *_ in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = Counter()
    for i, _, h, *_ in pages:
        raw = (h or "").encode()
        m = last.get(h or "")
        again = i is not None and m != i
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", m if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    order = [(r["urlkey"], r["captured"]) for r in rows]
    assert order == sorted(order)
    large = warc.capture_index(df, least=1000).where("record_type = 'revisit'").collect()
    assert large and all(r["payload_bytes"] >= 1000 for r in large)
    assert warc.capture_index(spark.createDataFrame([], PAGES)).collect() == []


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("https://x.y.org:8080") == "org,y,x:8080)/"


def test_records_by_hand():
    data = warc.write_record(5, "http://a/\r\nEvil: 1", 0, b"body\r\n\r\nmore", None) + warc.write_record(4, "http://a/", 1, b"body", 5)
    (a0, n0, h0, b0), (a1, _, h1, b1) = warc.read_records(data)
    assert (a0, a1) == (0, n0) and h0["WARC-Type"] == "response" and b0.endswith(b"\r\n\r\nbody\r\n\r\nmore") and "Evil" not in h0
    assert h1["WARC-Type"] == "revisit" and h1["X-Refers-To-Page-ID"] == "5" and not b1.endswith(b"body")
    with pytest.raises(ValueError):
        list(warc.read_records(b"\x1f\x8b" + __import__("gzip").compress(b"no record")[2:]))


def test_hostile_containers(spark):
    """Deep nesting, counts that claim more than there is, and key samples that aren't there give an error each, and little memory is taken."""
    good = media.write_media(os.urandom(4096))
    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    full = lambda *x: struct.pack(f">{len(x) + 1}I", 0, *x)
    bad = [
        deep,
        good.replace(full(0, 4, 1024, 1024, 1024, 1024), full(1, 2**32 - 1, 1024, 1024, 1024, 1024)),  # stsz: 2**32 - 1 samples of one byte
        good.replace(full(0, 4, 1024, 1024, 1024, 1024), full(0, 2**32 - 1, 1024, 1024, 1024, 1024)),
        good.replace(b"stss" + full(1, 1), b"stss" + full(1, 0)),
        good.replace(b"stss" + full(1, 1), b"stss" + full(1, 99)),
        good.replace(b"stss" + full(1, 1), b"stss" + full(2**31, 1)),
        good.replace(b"stsc" + full(1, 1, 4, 1), b"stsc" + full(1, 1, 2**31, 1)),
        good.replace(b"stsc" + full(1, 1, 4, 1), b"stsc" + full(1, 2, 4, 1)),
        media.box(b"ftyp", b"isom") + media.box(b"moof", b""),
        b"\0" * 7,
        media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd", b"")))),
    ]
    assert all(b != good for b in bad)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([good, *bad])], "page_id long, media binary")
    got = {r["page_id"]: r for r in media.media_columns(df, "media", "page_id").collect()}
    assert got[0]["media_error"] is None and got[0]["n_samples"] == 4
    assert all(got[i]["media_error"] and got[i]["key_ranges"] is None for i in range(1, len(bad) + 1)), [i for i in got if not got[i]["media_error"]]


def test_compact_sample_sizes():
    """stz2 tables of 4, 8 and 16 bits."""
    for bits, sizes in ((4, [3, 15, 0, 7, 9]), (8, [200, 1, 0]), (16, [300, 65535])):
        packed = b"".join(bytes([a << 4 | b]) for a, b in zip(sizes[::2], [*sizes[1::2], 0], strict=False)) if bits == 4 else struct.pack(f">{len(sizes)}{'B' if bits == 8 else 'H'}", *sizes)
        t = media.Track(10**6, tables={b"stz2": struct.pack(">IBBBBI", 0, 0, 0, 0, bits, len(sizes)) + packed, b"stco": struct.pack(">III", 0, 1, 50), b"stsc": struct.pack(">IIIII", 0, 1, 1, len(sizes), 1)})
        ends = np.cumsum(sizes) + 50
        assert t.samples() == list(zip((ends - sizes).tolist(), ends.tolist(), strict=True)) and t.keys() == list(range(len(sizes)))


def test_fixed_sample_sizes():
    t = media.Track(1000, tables={b"stsz": struct.pack(">III", 0, 10, 6), b"stco": struct.pack(">IIII", 0, 2, 100, 300), b"stsc": struct.pack(">IIIIIIII", 0, 2, 1, 4, 1, 2, 2, 1)})
    assert t.samples() == [(100, 110), (110, 120), (120, 130), (130, 140), (300, 310), (310, 320)]


def test_archives_are_read_in_linear_time():
    page = lambda i: warc.write_record(i, "http://a/", i, os.urandom(200), None)
    data = b"".join(page(i) for i in range(3000))
    fed = []
    real = warc.zlib.decompressobj

    class Spy:
        def __init__(self, *a):
            self.own = real(*a)

        def decompress(self, part):
            fed.append(len(part))
            return self.own.decompress(part)

        def __getattr__(self, name):
            return getattr(self.own, name)

    warc.zlib.decompressobj = Spy
    try:
        rows = list(warc.read_records(data))
    finally:
        warc.zlib.decompressobj = real
    assert len(rows) == 3000 and [r[2]["X-Page-ID"] for r in rows[:3]] == ["0", "1", "2"]
    assert sum(fed) <= 3000 * (warc.FEED + 1000)  # not the rest of the archive for each record
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(data[:-5]))


def test_index_in_many_ranges(spark, monkeypatch):
    """Order and rows stay the same in ranges of a few lines, with one URL, time and page that many rows share."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = [(i % 40 if i % 3 else 7, f"http://h{i % 5 if i % 3 else 0}.org/", f"<p>{i % 11}</p>", "a", 1, "s") for i in range(900)]
    rows = warc.capture_index(spark.createDataFrame(pages, PAGES).repartition(3)).collect()
    order = [(r["urlkey"], r["captured"], r["page_id"], r["archive"], r["offset"]) for r in rows]
    assert len(rows) == 900 and order == sorted(order)
    last = {}
    for i, _, h, *_ in pages:
        last[h] = max(last.get(h, i), i)
    want = Counter((i, len(h), last[h] if last[h] != i else None) for i, _, h, *_ in pages)
    assert Counter((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in rows) == want


def test_long_texts(spark, words):
    """Texts of some megabytes, whole, through the encoders."""
    r = random.Random(5)
    text = " ".join("".join(r.choice(["an", "er", "the", "in", "st", "é"]) for _ in range(r.randint(1, 4))) for _ in range(300_000))
    from .conftest import DOCS, rows as made

    df = spark.createDataFrame(made([(1, text), (2, "short"), (3, None)]), DOCS)
    raw = text.encode()
    by = {x["doc_id"]: x for x in media.store_documents(df).collect()}
    assert (by[1]["n_bytes"], by[1]["payload_bytes"]) == (len(raw), -(-len(raw) // 64) * 64) and by[3]["payload_bytes"] == 64
    by = {x["doc_id"]: x for x in byte_bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert by[1]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
    check_packing(packing.pack(df, packing.word_encoder(WORDS)).collect(), [(1, text), (2, "short"), (3, None)], words, 4096)


def test_media_sql(docs, texts):
    import duckdb

    from recordflow.llm.oracles import ORACLE_SQL

    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [(i, t) for i, t in texts if "\x00" not in (t or "")])
    want = c.execute(ORACLE_SQL["op8_media"])
    names = [x[0] for x in want.description]
    got = media.store_documents(docs.where("text is null or instr(text, char(0)) = 0")).select(*names).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())
