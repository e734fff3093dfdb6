"""Operator 4: exact Jaccard join of word shingle sets by universe partition.

Sets of similar size differ in few tokens: J >= 0.8 leaves a symmetric difference of
at most U = (|x| + |y|) / 9. Sizes fall into bands. In a band the universe of tokens
is cut by hash into m segments; the bound of differences is shared out among the
segments a probe picks, 1 for a segment that must be equal, 2 for one that may differ
by one token, and U + 1 in all. By the pigeonhole principle a partner within the
bound agrees in one of them. A document is indexed by its segments in its own band,
and by their one-deletion neighbourhoods in some of these, and probes its own band
and the next lower one.

1. Documents with equal sets are one class, known by its smallest id.
2. Class representatives send the hashes of their segments, dealt by hash; a group of
   documents sends an equal hash once, with counts. Each partition answers how many
   partners a segment would bring.
3. Each representative picks the cheapest segments that reach U + 1 (a hot or empty
   segment is skipped where others suffice). A picked segment without partners costs
   nothing; most have none.
4. A token that no other candidate's set has differs from every partner, whatever its
   segment: two sets with more such tokens than the bound can't link and are no pair.
   Each set has a sketch of the parities of its tokens' hashes; two sketches differ in at
   most as many bits as their sets do in tokens, so pairs with more are no pair either.
   Both are lossless and part of the join that makes pairs.
5. Each picked segment gives a pair with its partner of the fewest lone tokens; pairs are
   verified exactly on the whole sets. Candidates that these links don't connect already
   are then verified too, a growing number of partners of each segment at a time, until
   every candidate is refused, verified or in one component. ``jaccard_links`` verifies all
   candidates instead, and gives every link and the number of links of each row.

Defined results: null texts and texts without words have no shingles and are their own
component; fewer than ``words`` words are one shingle; rows with one id are one node;
a row without an id has no links and no component; very long texts are handled whole, one
at a time; other columns are ignored; an empty table gives an empty result. Shingles are
compared by 64-bit hashes, sets as a whole by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import groups as G
from .common import SALTS, U64, Chunk, Words, by_document, chunks, discard, freeing, join_hashes, materialise, mix, part_of, partitions, runs, window_hash
from .components import components

GROUP_ENTRIES = 1_000_000  # segment hashes of a group of documents
LOW = U64(0xFFFFFFFF)
SKETCH = 16  # longs of parities of a set
MEMBERS = "key long, node long, n int, form int, own boolean, wants0 boolean, wants1 boolean"


@dataclass(frozen=True)
class Similarity:
    """Links are pairs with 100 * intersection >= percent * union, over shingles of ``words`` words."""

    percent: int = 80
    words: int = 5

    def differences(self, x, y):
        """The most tokens in which linked sets of these sizes can differ."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)


class Bands:
    """Size bands, with the segments of each and how many of these have deletion neighbourhoods."""

    def __init__(self, most: int, like: Similarity):
        ends = [1]
        while ends[-1] < most:
            low = ends[-1] + 1
            ends.append(max(low, 100 * low // like.percent))
        self.end = np.array(ends, np.int64)
        widest = 100 * self.end // like.percent  # the largest partner of a set in the band
        need = like.differences(widest, self.end) + 1
        self.segments = need + need // 16
        self.loose = -(-self.segments // 16) * (need > 1)  # segments with deletion neighbourhoods
        self.slots = self.segments + self.loose
        self.like = like

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, n)

    def probes_below(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can have partners in the next lower band."""
        least = -(-self.like.percent * n // 100)
        return (band > 0) & (least <= self.end[np.maximum(band - 1, 0)])

    def need(self, n: int, band: int) -> int:
        return int(self.like.differences(n, min(int(self.end[band]), n))) + 1


@cache
def bands(power: int, like: Similarity) -> Bands:
    return Bands(1 << power, like)


class Shingles:
    """The distinct shingles of each document of a chunk: document and hash, by document and hash."""

    def __init__(self, chunk: Chunk, like: Similarity):
        w = Words(chunk, lower=True)
        many = np.diff(w.docs)
        at = w.windows(like.words)
        doc, h = [w.doc_of()[at]], [window_hash(w.hash, like.words)[at]]
        for k in range(1, like.words):  # documents of fewer words are one shingle each
            short = np.flatnonzero(many == k)
            whole = np.full(len(short), k, U64)
            for j in range(k):
                whole = join_hashes(whole, w.hash[w.docs[short] + j])
            doc.append(short)
            h.append(whole)
        doc, h = np.concatenate(doc), np.concatenate(h)
        order = by_document(doc, h)
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.hash = doc[new], h[new]
        self.first = np.searchsorted(self.doc, np.arange(len(many) + 1))
        self.n = np.diff(self.first)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums of values modulo 2**64 over each document."""
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def set_keys(docs: DataFrame, like: Similarity) -> DataFrame:
    """doc_id, tag, n_shingles and a 128-bit key of the set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            s = Shingles(chunk, like)
            k = [mix(s.total(mix(s.hash ^ U64(b))) + s.n.astype(U64)).view(np.int64) for b in SALTS]
            yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), chunk.rows.column("tag"), pa.array(s.n), pa.array(k[0]), pa.array(k[1])], ["doc_id", "tag", "n_shingles", "k0", "k1"])

    return docs.mapInArrow(run, "doc_id long, tag long, n_shingles long, k0 long, k1 long")


def segment_entries(s: Shingles, like: Similarity) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of entries: document, slot, hash, form (0 whole, 1 with a token deleted), own band or not.

    A document's slots are the segments of its own band, its loose segments again,
    and then both of the lower band.
    """
    power = max(10, int(s.n.max(initial=1)).bit_length())
    b = bands(power, like)
    value = mix(s.hash ^ U64(SALTS[1]))
    own_band = b.of(s.n)
    for down in (0, 1):
        band = own_band - down
        docs = np.flatnonzero((s.n > 0) & (b.probes_below(s.n, own_band) if down else True))
        if not len(docs):
            continue
        in_use = np.zeros(len(s.n), bool)
        in_use[docs] = True
        tokens = in_use[s.doc]
        doc, h, v = s.doc[tokens], s.hash[tokens], value[tokens]
        size = np.where(in_use, b.segments[np.maximum(band, 0)], 0)
        base = np.cumsum(size) - size
        seed = mix(band.astype(np.int64).view(U64) + U64(SALTS[0]))
        seg = ((mix(h ^ seed[doc]) >> U64(32)) * size[doc].astype(U64) >> U64(32)).astype(np.int64)
        place = base[doc] + seg
        order = np.argsort(place)
        place, v, doc, seg = place[order], v[order], doc[order], seg[order]
        cuts = runs(place)
        sums = np.zeros(int(size.sum()), U64)
        if len(place):
            sums[place[cuts[:-1]]] = np.add.reduceat(v, cuts[:-1])
        of = np.repeat(np.arange(len(size)), size)
        which = np.arange(len(sums)) - base[of]
        salt = mix(seed[of] + which.astype(U64))
        first = np.where(down, b.slots[own_band], 0)
        yield of, first[of] + which, mix(sums + salt), np.zeros(len(sums), np.uint8), np.full(len(sums), not down)
        loose = seg < b.loose[np.maximum(band, 0)][doc]
        doc, seg, place, v = doc[loose], seg[loose], place[loose], v[loose]
        yield doc, first[doc] + b.segments[np.maximum(band, 0)][doc] + seg, mix(sums[place] - v + salt[place]), np.ones(len(doc), np.uint8), np.full(len(doc), not down)


def signatures(docs: DataFrame, like: Similarity, parts: int) -> DataFrame:
    """Packed segment hashes of representatives (columns doc_id, text, tag); the lower half of a tag becomes the set's size."""

    def flush(group: G.Group) -> pa.RecordBatch:
        h, place, form, own = (np.concatenate([x[k] for x in group.held]) for k in range(4))
        order = np.lexsort((form, h))
        h, place, form, own = h[order], place[order], form[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (form[1:] != form[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        held = np.add.reduceat(own.astype(np.int64), first) if len(first) else first
        alike = (place[~new].astype(np.uint32), np.repeat(place[first], size)[~new].astype(np.uint32))
        h, place, form = h[first], place[first], form[first]
        data = []
        for p, a, b in G.by_part(part_of(h, parts)):
            low = h[a:b] & LOW
            by = np.argsort(low)
            data.append((p, G.dump(np.diff(low[by], prepend=U64(0)).astype(np.uint32), place[a:b][by].astype(np.uint32), form[a:b][by], size[a:b][by].astype(np.uint32), held[a:b][by].astype(np.uint32))))
        return group.rows(parts, data, None, alike)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = G.Group()
        for chunk in chunks(batches):
            s = Shingles(chunk, like)
            b = bands(max(10, int(s.n.max(initial=1)).bit_length()), like)
            band = b.of(s.n)
            slots = b.slots[band] + np.where(b.probes_below(s.n, band), b.slots[np.maximum(band - 1, 0)], 0)
            tags = chunk.rows.column("tag").to_numpy() & ~np.int64(LOW) | s.n
            bases = group.add(chunk.ids, tags, np.where(s.n > 0, slots, 0))
            for doc, slot, h, form, own in segment_entries(s, like):
                group.held.append((h, bases[doc] + slot, form, own))
                group.weight += len(h)
            if group.weight >= GROUP_ENTRIES:
                yield flush(group)
        if group.held:
            yield flush(group)

    return docs.mapInArrow(run, G.PACKED)


def shared_segments(rows: DataFrame) -> DataFrame:
    """Of each partition, the entries with partners: place, hash, form, partners whole and with a deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, out = G.incoming(batches)
        part = TaskContext.get().partitionId()
        if data:
            unpacked = [G.load(p) for _, p in data]
            h = np.concatenate([np.cumsum(u[0], dtype=np.uint32) for u in unpacked])
            place, form, count, held = (np.concatenate([u[k] for u in unpacked]) for k in (1, 2, 3, 4))
            grp = np.repeat([g for g, _ in data], [len(u[0]) for u in unpacked])
            del unpacked, data
            order = np.argsort(h)
            cuts = runs(h[order])
            many = np.diff(cuts)
            told = [np.add.reduceat(np.where(form[order] == f, held[order], 0).astype(np.int64), cuts[:-1]) for f in (0, 1)]
            whole = np.add.reduceat((form[order] == 0).astype(np.int64), cuts[:-1])
            good = (np.add.reduceat(count[order].astype(np.int64), cuts[:-1]) > 1) & (whole > 0) & (told[0] + told[1] > 0)
            at = order[np.repeat(good, many)]
            n0, n1 = (np.repeat(t[good], many[good]) for t in told)
            key = (np.int64(part) << 32) | h[at].astype(np.int64)
            out += G.answers(grp[at], place[at], key, form[at], n0.astype(np.uint32), n1.astype(np.uint32))
        yield G.packed(out)

    return rows.mapInArrow(run, G.PACKED)


def pick(n: int, fields: list[np.ndarray], like: Similarity) -> tuple[np.ndarray, ...]:
    """Which answers a set of size n probes: per entry own band or not, and whether it wants whole or deleted partners."""
    slot, _, form, n0, n1 = fields[:5]
    b = bands(max(10, n.bit_length()), like)
    band = int(b.of(np.array([n]))[0])
    own = slot < b.slots[band]
    wants0, wants1 = np.zeros(len(slot), bool), np.zeros(len(slot), bool)
    for down in (0, 1):
        at = np.flatnonzero(own != bool(down))
        if not len(at):
            continue
        c = band - down
        m, loose = int(b.segments[c]), int(b.loose[c])
        inside = slot[at].astype(np.int64) - (int(b.slots[band]) if down else 0)
        whole = form[at] == 0
        seg = np.where(whole, inside, inside - m)
        equal, near = np.zeros(m, np.int64), np.zeros(loose, np.int64)
        equal[seg[whole]] = n0[at][whole].astype(np.int64) - (0 if down else 1)
        by_deleted = whole & (seg < loose)
        np.add.at(near, seg[by_deleted], n1[at][by_deleted].astype(np.int64))
        np.add.at(near, seg[~whole], n0[at][~whole].astype(np.int64))
        costs = np.concatenate([equal, np.maximum(near, equal[:loose])])  # the second unit of a segment comes after its first
        picked = np.argsort(costs, kind="stable")[: b.need(n, c)]
        chosen = np.zeros(m + loose, bool)
        chosen[picked] = True
        exact, loosely = chosen[:m], np.concatenate([chosen[m:], np.zeros(m - loose, bool)])
        wants0[at] = np.where(whole, exact[seg] & (equal[seg] > 0), loosely[seg])
        wants1[at] = whole & loosely[seg]
    return own, wants0, wants1


def members(found: DataFrame, like: Similarity) -> DataFrame:
    """Rows of shared segments: what each representative indexes there, and which partners it wants."""
    names = [x.split()[0] for x in MEMBERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for node, n, spans in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("spans"), strict=True):
                f, n = G.load(spans.as_py()), n & int(LOW)
                own, w0, w1 = pick(n, f, like)
                keep = own | w0 | w1
                k = int(keep.sum())
                out.append((f[1][keep], np.full(k, node), np.full(k, n, np.int32), f[2][keep].astype(np.int32), own[keep], w0[keep], w1[keep]))
                size += k
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return found.mapInArrow(run, MEMBERS)


def verified(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Those pairs (a, b) of nodes that link, by their whole sets."""
    percent = like.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    one, two = (sets.select(F.col("node").alias(k), F.col("members").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def parities(s: Shingles) -> np.ndarray:
    """Of each document SKETCH longs: bit i is the parity of the tokens whose hash falls on i.

    The bits in which two sketches differ are at most the tokens in which the sets do.
    """
    at = mix(s.hash ^ U64(SALTS[0])) >> U64(64 - (64 * SKETCH - 1).bit_length())
    out = np.zeros(len(s.n) * SKETCH, U64)
    np.bitwise_xor.at(out, s.doc * SKETCH + (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return out.reshape(-1, SKETCH).view(np.int64)


def set_table(docs: DataFrame, like: Similarity) -> DataFrame:
    """node, n, members (sorted 64-bit hashes) and the sketch p0, p1 and so on of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            s = Shingles(chunk, like)
            raw = [s.hash[a:b].tobytes() for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), pa.array(s.n.astype(np.int32)), pa.array(raw, pa.binary()), *map(pa.array, np.ascontiguousarray(parities(s).T))], ["node", "n", "members", *(f"p{i}" for i in range(SKETCH))])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, n int, members binary, " + ", ".join(f"p{i} long" for i in range(SKETCH)))


def lone_tokens(sets: DataFrame) -> DataFrame:
    """node, lone: how many tokens of a node no other set of the table has; 0 for nodes of several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                token = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("members")]
                node = np.repeat(part.column("node").to_numpy(), [len(t) for t in token])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(node)], ["token", "node"])

    single = sets.mapInArrow(run, "token long, node long").groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    several = sets.groupBy("node").count().where("count > 1").select("node")
    return single.groupBy("node").agg(F.count("*").alias("lone")).join(several, "node", "left_anti")


def can_link(n, lone, m, other_lone, percent: int):
    """Whether sets of sizes n and m can link when so many tokens of each are in no other set."""
    most = F.least(n - lone, m - other_lone, F.floor((n + m - lone - other_lone) / 2))
    return most * 100 >= (n + m - most) * percent


def _with_component(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    return nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))


PARTNER = "struct(lone, node, form, n)"  # in order of rank: a text that many copies come from has no lone tokens


def segment_rows(own: DataFrame, reps: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """Rows of the shared segments of representatives that can have links, and their sets."""
    spark, parts = own.sparkSession, partitions(own.sparkSession)
    texts = own.join(reps.select("doc_id", "tag"), ["doc_id", "tag"], "left_semi")
    answers = materialise(shared_segments(G.deal(signatures(texts, like, parts), parts)), "segments")
    found = materialise(members(G.per_document(answers, parts, once=False), like), "members")
    discard(answers)
    wanted = found.where("wants0 or wants1").select("key").distinct()
    live = found.join(wanted, "key", "left_semi")
    nodes = live.select("node").distinct()
    sets = materialise(set_table(texts.join(nodes, texts.doc_id == nodes.node, "left_semi"), like), "sets")
    lone = lone_tokens(sets)
    rows = live.join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    rows = materialise(rows.where((F.col("n") - F.col("lone")) * 100 >= F.col("n") * like.percent).select("key", "node", "n", "lone", "form", "own", "wants0", "wants1"), "rows")
    discard(found)
    return rows, sets


def with_sketches(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return rows.join(sets.drop("members"), ["node", "n"])


def candidates(wanting: DataFrame, some: DataFrame, like: Similarity) -> DataFrame:
    """Pairs of rows that want a partner and rows of the same key that they can link to.

    Refused are pairs of one component, where components are told, pairs with too many
    lone tokens, and, where sketches are told, pairs whose parities differ too often: none of these can be a new link.
    """
    told = [("component", "there")] * ("component" in some.columns) + [(f"p{i}", f"q{i}") for i in range(SKETCH)] * ("p0" in some.columns)
    other = some.select("key", *(F.col(x).alias(y) for x, y in [("node", "other"), ("n", "m"), ("lone", "gone"), ("form", "kind"), *told]))
    met = wanting.join(other, "key").where("node <> other and ((kind = 0 and wants0) or (kind = 1 and wants1))")
    if "component" in some.columns:
        met = met.where("component <> there")
    met = met.where(can_link(F.col("n"), F.col("lone"), F.col("m"), F.col("gone"), like.percent))
    if "p0" in some.columns:
        met = met.where(" + ".join(f"bit_count(p{i} ^ q{i})" for i in range(SKETCH)) + f" <= ({100 - like.percent} * (n + m)) div {100 + like.percent}")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def links_of(own: DataFrame, reps: DataFrame, like: Similarity) -> DataFrame:
    """node, component of the representatives that link (other than the least of a component).

    The rows of a segment lie at places from 0 to their number, by a hash of the node;
    each round takes the partners in the next stretch of these places, in all segments
    that still join several components. So no segment's rows are ordered or must be in one
    task; where they join, both sides are tables, and Spark splits a hot key.
    """
    rows, sets = segment_rows(own, reps, like)
    hub = materialise(rows.where("own").groupBy("key").agg(F.min(F.expr(PARTNER)).alias("hub")).select("key", "hub.*"), "hubs")  # a table, so that the join can split a hot key
    tested = materialise(candidates(rows.where("wants0 or wants1"), hub, like), "tested")
    comp = components(verified(tested, sets, like))
    low, width, place = 0, 2, F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("many") / (1 << 30)
    refuted, old = tested, [rows, sets, hub, tested]
    while True:
        placed = _with_component(rows, comp)
        mixed = materialise(placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum(F.col("own").cast("long")).alias("many")).where("c0 <> c1").select("key", "many"), "mixed")
        left = materialise(with_sketches(placed.join(mixed, "key"), sets), "open")
        some = left.where("own").where((place >= low) & (place < low + width))
        more = materialise(candidates(left.where("wants0 or wants1"), some, like).join(refuted, ["a", "b"], "left_anti"), "tested")
        with freeing(own.sparkSession):
            done = mixed.where(F.col("many") > low + width).isEmpty()
        discard(left, mixed)
        new = materialise(verified(more, sets, like), "links")
        if not new.isEmpty():
            before = comp
            comp = components(new.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            discard(before)
        discard(new)
        if done:
            discard(*old, more)
            return comp
        old.append(more)
        refuted = refuted.unionByName(more)
        low, width = low + width, 8 * width


def representatives(keys: DataFrame) -> DataFrame:
    """Of each class of equal sets: n_shingles, key, the least doc_id and its tag."""
    classes = keys.where("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "k0", "k1").agg(F.min(F.struct("doc_id", "tag")).alias("least"))
    return classes.select("n_shingles", "k0", "k1", "least.doc_id", "least.tag")


def jaccard_components(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    own = G.keyed(docs)
    keys = materialise(set_keys(own, like), "set-keys")
    reps = materialise(representatives(keys), "classes")
    comp = links_of(own, reps, like)
    placed = _with_component(reps.withColumnRenamed("doc_id", "node"), comp).select("n_shingles", "k0", "k1", "component")
    linked = keys.join(placed, ["n_shingles", "k0", "k1"], "left")
    return linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def all_links(own: DataFrame, reps: DataFrame, like: Similarity) -> DataFrame:
    """All links (a, b) of the representatives, each verified on the whole sets; as many rows as there are."""
    rows, sets = segment_rows(own, reps, like)
    both = materialise(with_sketches(rows, sets), "open")
    tested = materialise(candidates(both.where("wants0 or wants1"), both.where("own"), like), "tested")
    return materialise(verified(tested, sets, like).distinct(), "links")  # repeated rows of a representative give their links again


def jaccard_links(docs: DataFrame, like: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n_shingles, class_id, representative_id, n_links; and all links (a, b) of different classes.

    A class holds the rows of equal sets, and is told by a number of its own;
    representative_id is the least id of it. n_links is the number of other documents
    that link to a row, copies and all; an id with several sets counts once for each.
    Rows without an id or without shingles have no class and no links.
    """
    own = G.keyed(docs)
    keys = materialise(set_keys(own, like), "set-keys")
    numbered = materialise(materialise(representatives(keys), "classes").withColumn("class_id", F.monotonically_increasing_id()), "classes")
    nodes = numbered.select("class_id", "doc_id", "tag")
    texts = own.join(nodes, ["doc_id", "tag"]).select(F.col("class_id").alias("doc_id"), "text", "tag")  # a class is one node, though an id may have several
    links = all_links(texts, nodes.select(F.col("class_id").alias("doc_id"), "tag"), like)
    placed = keys.join(numbered.select("n_shingles", "k0", "k1", "class_id", F.col("doc_id").alias("representative_id")), ["n_shingles", "k0", "k1"], "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).withColumn("representative_id", F.when(F.col("class_id").isNotNull(), F.col("representative_id")))
    size = materialise(placed.where("class_id is not null").select("class_id", "doc_id").distinct().groupBy("class_id").agg(F.count("*").alias("ids")), "sizes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(size.select(F.col("class_id").alias("b"), "ids"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("ids").alias("beside"))
    total = size.join(beside, "class_id", "left").select("class_id", (F.col("ids") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    return placed.join(total, "class_id", "left").select("doc_id", "n_shingles", "class_id", "representative_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), links


def keep_first(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all their columns.

    Rows without an id, and rows of equal id, all stay.
    """
    placed = jaccard_components(docs, like)
    gone = placed.where("component_id < doc_id").select(F.col("doc_id").alias("__rf_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__rf_gone"], "left_anti")
