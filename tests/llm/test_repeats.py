"""Word windows, byte strings and similar sets against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recordflow.llm import blocks, contexts, jaccard, suffixes
from recordflow.llm.common import Chunk, window_hash
from recordflow.llm.components import components
from recordflow.llm.jaccard import Bands, Similarity

from .conftest import DOCS, rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def drop_windows(texts, size):
    least = {}
    for i, t in texts:
        w = words(t)
        for s in range(len(w) - size + 1 if i is not None else 0):
            k = tuple(w[s : s + size])
            least[k] = min(least.get(k, i), i)
    out = Counter()
    for i, t in texts:
        w = words(t)
        gone = set()
        for s in range(len(w) - size + 1 if i is not None else 0):
            if least[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    return out


def drop_strings(texts, size):
    least = {}
    for i, t in texts:
        b = (t or "").encode()
        for s in range(len(b) - size + 1 if i is not None else 0):
            least[b[s : s + size]] = min(least.get(b[s : s + size], i), i)
    out = Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - size + 1 if i is not None else 0):
            if least[b[s : s + size]] < i:
                gone[s : s + size] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def similar(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in texts:
        w = words((t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    inverted, linked = defaultdict(set), 0
    for k, (i, s) in enumerate(sets):
        for h in s if i is not None else ():
            inverted[h].add(k)
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for h in s for j in inverted[h] if j < k) if i is not None else {}
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = root(i), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
                linked += 1
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets), linked


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_blocks(docs, texts):
    want = drop_windows(texts, 50)
    assert sum(k[2] for k in want) > 1000
    assert got(blocks.drop_repeats(docs)) == want


def test_suffixes(docs, texts):
    want = drop_strings(texts, 50)
    assert sum(k[2] for k in want) > 5000
    assert got(suffixes.drop_repeats(docs)) == want


def test_suffixes_of_common_anchors(docs, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "COMMON", 1)  # each anchor that two partitions share sends single strings
    assert got(suffixes.drop_repeats(docs)) == drop_strings(texts, 50)


def test_jaccard(docs, texts):
    want, linked = similar(texts)
    assert linked > 40
    assert got(jaccard.jaccard_components(docs)) == want


@pytest.mark.parametrize("operator", [blocks.drop_repeats, suffixes.drop_repeats, jaccard.jaccard_components])
def test_empty(no_docs, operator):
    assert operator(no_docs).collect() == []


def test_columns_stay(docs, texts):
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    first = {i: c for (i, _, c) in similar(texts)[0]}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in texts if i is None or first[i] == i)
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert sum(len((r["text"] or "").encode()) for r in cut.collect()) <= sum(k[1] - k[2] for k in drop_strings(texts, 50).elements())


def test_characters_stay_whole(spark):
    a, b = "ã" * 40 + "b" * 10, "á" + "ã" * 40 + "b" * 10  # the repeat may begin within a character
    out = {r["doc_id"]: r["text"] for r in suffixes.cut_repeats(spark.createDataFrame(rows([(1, a), (2, b)]), DOCS)).collect()}
    assert out[1] == a and set(out[2]) <= {"á"}


def test_levels_of_suffix_arrays():
    r = random.Random(1)
    levels, seen = suffixes.SuffixLevels(4), {}
    for batch in range(40):
        strings = [bytes(r.choice(b"ab\0") for _ in range(4)) for _ in range(r.randint(1, 9))]
        ids = [batch * 10 + r.randint(0, 3) for _ in strings]
        hit = levels.add(np.array(strings, "S4"), np.array(ids))
        least = dict(seen)
        for s, i in zip(strings, ids, strict=True):
            least[s] = min(least.get(s, i), i)
        assert [bool(h) for h in hit] == [least[s] < i for s, i in zip(strings, ids, strict=True)]
        seen = least
        sizes = [len(x) for x in levels.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == len(seen)


def test_pigeonhole():
    """Every linked pair of set sizes has enough segments to pick from, in a band that the larger probes."""
    like = Similarity()
    b = Bands(4000, like)
    for x in range(1, 3000, 7):
        for y in range(-(-80 * x // 100), x + 1):
            if 100 * y < 80 * x:
                continue
            band, own = int(b.of(np.array([y]))[0]), int(b.of(np.array([x]))[0])
            assert own - band in (0, 1)
            assert own == band or bool(b.probes_below(np.array([x]), np.array([own]))[0])
            assert like.differences(x, y) + 1 <= b.need(x, band) <= b.segments[band]


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {row["node"]: row["component"] for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in parent} == {n: root(n) for n in parent}


def test_jaccard_links(spark, docs, texts, no_docs):
    r = random.Random(12)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    near = []
    for i in range(60):  # one large group of near copies, some of them copied, some too far from others to link
        w = list(base)
        for k in range(i % 4):
            w[r.randrange(len(w))] = f"v{i}{k}"
        near += [(5000 + i, " ".join(w))] * (1 + i % 2) + [(7000 + i, " ".join(w))] * (i % 3 == 0)
    more = [*near, (100, "another text of an id that is there already"), (8000, "another text of an id that is there already")]
    df = docs.unionByName(spark.createDataFrame(rows(more), DOCS))

    def shingles(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {(i, shingles(t)) for i, t in texts + more if i is not None and shingles(t)}
    want = {x: sum(100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1]) for y in sets) - 1 for x in sets}
    members = defaultdict(set)
    for i, x in sets:
        members[x].add(i)
    got, links = jaccard.jaccard_links(df)
    got = got.collect()
    expected = Counter((i, len(shingles(t)), want.get((i, shingles(t)), 0), min(members[shingles(t)]) if (i, shingles(t)) in want else None) for i, t in texts + more)
    assert Counter((x["doc_id"], x["n_shingles"], x["n_links"], x["representative_id"]) for x in got) == expected
    assert len({x["class_id"] for x in got} - {None}) == len(members)
    linked = [(x, y) for x in members for y in members if x != y and 100 * len(x & y) >= 80 * len(x | y)]
    assert links.count() == links.distinct().count() == len(linked) // 2 > 200
    assert jaccard.jaccard_links(no_docs)[0].collect() == []


def thue_morse(n, a, b):
    """The word of n letters that begins with a, and the one with its letters swapped: polynomials modulo 2**64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def cancelling_texts():
    """Texts that agree under any sum of values times powers of an odd number modulo 2**64."""
    r = random.Random(21)
    prose = lambda k: [f"p{r.randrange(10**6)}" for _ in range(k)]
    out = []
    for n in (1024, 2048, 4096):
        out += list(thue_morse(n, "a", "b"))  # one long word each
        x, y = thue_morse(n, "a", "b")
        tail = prose(60)
        out += [" ".join([x, *tail[:30]]), " ".join([y, *tail[:30]])]
    x, y = thue_morse(1024, "a", "b")
    for k in range(61):  # windows whose words differ in one place only
        out.append(" ".join([*prose(1), x if k % 2 else y] + ["same"] * 59 + [f"q{k}"] * (k % 3)))
    for a, b in (("u ", "v "), ("up ", "down ")):  # words in the order of the letters
        out += list(thue_morse(128, a, b))
    return list(enumerate(out, 1))


@pytest.fixture(scope="module")
def cancelling(spark):
    texts = cancelling_texts()
    return texts, spark.createDataFrame(rows(texts), DOCS).repartition(3)


@pytest.mark.parametrize(("operator", "brute"), [(blocks.drop_repeats, lambda t: drop_windows(t, 50)), (suffixes.drop_repeats, lambda t: drop_strings(t, 50)), (jaccard.jaccard_components, lambda t: similar(t)[0])])
def test_texts_that_cancel_out(cancelling, operator, brute):
    texts, df = cancelling
    assert got(operator(df)) == brute(texts)


def test_window_hashes():
    r = np.random.default_rng(4)
    values = r.integers(0, 3, 400).astype(np.uint64)  # many equal windows
    for k in (1, 2, 3, 5, 25, 50):
        h = window_hash(values, k)
        seen = {}
        for i in range(len(values) - k + 1):
            assert seen.setdefault(int(h[i]), values[i : i + k].tobytes()) == values[i : i + k].tobytes()
        assert len(h) == 401 - k and len(seen) == len({values[i : i + k].tobytes() for i in range(len(h))})
    assert len(window_hash(values[:3], 4)) == 0


def test_blocks_that_many_hold(docs, texts, monkeypatch):
    monkeypatch.setattr(blocks, "COMMON", 1)  # each block that two partitions share sends single windows
    assert got(blocks.drop_repeats(docs)) == drop_windows(texts, 50)


def test_levels_of_suffixes_that_overlap():
    r = random.Random(2)
    levels, seen = suffixes.SuffixLevels(6), {}
    for batch in range(30):
        text = bytes(r.choice(b"ab\0") for _ in range(r.randint(6, 60)))
        place = np.arange(len(text) - 5)
        hit = levels.add_suffixes(np.frombuffer(text, np.uint8), place, np.full(len(place), batch))
        strings = [text[i : i + 6] for i in place]
        assert [bool(h) for h in hit] == [s in seen for s in strings]
        seen |= dict.fromkeys(strings, batch)
        for level in levels.levels:
            own = [level.text[i : i + 6].tobytes() for i in level.place]
            assert own == sorted(set(own))


def test_near_copies_on_either_side_of_the_bound(spark):
    """A large group whose pairs lie on both sides of 80 %, and that only chains hold together."""
    r = random.Random(31)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    made = []
    for i in range(400):
        w = list(base if i % 5 else made[-1][1].split() if made else base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"v{r.randrange(300)}"
        made.append((i, " ".join(w)))
    want, linked = similar(made)
    components_of = Counter(c for _, _, c in want.elements())
    assert linked > 3000 and len(components_of) > 20 and max(components_of.values()) > 100
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows(made), DOCS).repartition(6))) == want


def test_parities_never_refuse_a_link():
    r = random.Random(7)
    for _ in range(200):
        a = [f"t{r.randrange(4000)}" for _ in range(r.randint(5, 400))]
        b = list(a)
        for _ in range(r.randint(0, 30)):
            b[r.randrange(len(b))] = f"t{r.randrange(4000)}"
        data = [" ".join(x).encode() for x in (a, b)]
        bounds = np.array([0, len(data[0]), len(data[0]) + len(data[1])])
        s = jaccard.Shingles(Chunk(np.arange(2), np.frombuffer(b"".join(data), np.uint8), bounds, None), Similarity())
        x, y = (set(s.hash[s.first[i] : s.first[i + 1]].tolist()) for i in (0, 1))
        p = jaccard.parities(s).view(np.uint64)
        assert sum(bin(int(u) ^ int(v)).count("1") for u, v in zip(*p, strict=True)) <= len(x ^ y)


def long_text(n, seed):
    r = random.Random(seed)
    return " ".join(f"{r.randrange(36**4):x}" for _ in range(n))


def test_texts_of_some_megabytes(spark):
    long = long_text(500_000, 1)  # over 2 MB
    texts = [(1, long), (2, "head: " + long[1_000_000:] + " tail"), (3, long), (4, long_text(200, 2))]
    df = spark.createDataFrame(rows(texts), DOCS).repartition(2)
    words_of = lambda t: len(t.split())
    by = {r["doc_id"]: r for r in blocks.drop_repeats(df).collect()}
    whole = long[1_000_000:].split()
    first = int(" " not in long[999_999:1_000_001])  # a word cut in two is another word
    assert (by[1]["n_removed"], by[2]["n_removed"], by[3]["n_removed"], by[4]["n_removed"]) == (0, len(whole) - first, words_of(long), 0)
    by = {r["doc_id"]: r for r in suffixes.drop_repeats(df).collect()}
    assert (by[1]["n_removed"], by[3]["n_removed"], by[4]["n_removed"]) == (0, len(long), 0) and by[2]["n_removed"] in (len(long) - 1_000_000, len(long) - 999_999)
    by = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert by == {1: 1, 2: 2, 3: 1, 4: 4}


def test_family_of_batches(spark, docs, texts):
    """Batches of rising id, one at a time, give what all of them give at once; levels stay geometric."""
    family = suffixes.SuffixFamily(spark, parts=3)
    ids = sorted({i for i, _ in texts if i is not None})
    edges = [0, 7, 9, 30, 33, 60, 75, len(ids)]
    got = Counter()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        batch = [(i, t) for i, t in texts if i is not None and ids[a] <= i <= ids[b - 1]]
        got.update(tuple(r) for r in family.add(spark.createDataFrame(rows(batch), DOCS).repartition(2)).collect())
        sizes = [n for _, _, n in family.levels]
        assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:], strict=False))
    assert got == Counter({k: v for k, v in drop_strings(texts, 50).items() if k[0] is not None})
    assert family.add(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="not above"):
        family.add(spark.createDataFrame(rows([(ids[0], "x" * 60)]), DOCS))


@pytest.mark.parametrize(("module", "brute"), [(blocks, drop_windows), (suffixes, drop_strings)])
def test_contexts_in_many_slices(docs, texts, monkeypatch, module, brute):
    """What a document sends can go in many pieces, before its group is closed."""
    monkeypatch.setattr(module, "GROUP_BYTES", 3000)
    assert got(module.drop_repeats(docs)) == brute(texts, 50)


def test_gathered_bytes(monkeypatch):
    monkeypatch.setattr(contexts, "SLICE", 100)
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    for n in (0, 1, 5, 300):
        start, size = r.integers(0, 4000, n), r.integers(1, 400, n)
        assert contexts.gather_bytes(data, start, size).tobytes() == b"".join(data[a : a + b].tobytes() for a, b in zip(start, size, strict=True))
        parts = list(contexts.slices(size, 700))
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(n))


def test_levels_are_scanned_a_bounded_number_of_times(monkeypatch):
    """80,000 contexts in one partition, in pairs that share the first 55 of 62 bytes."""
    n, r, laid = 80_000, np.random.default_rng(5), []
    text = r.integers(0, 256, (n, 62), np.uint8)
    text[1::2, :55] = text[::2, :55]
    text[1::2, 55] = text[::2, 55] ^ 1
    heads = contexts.Heads(np.zeros(n, np.uint64), np.arange(n), np.full(n, 13), text.reshape(-1), np.arange(n) * 62, np.full(n, 62))
    strings = suffixes.SuffixLevels.strings
    monkeypatch.setattr(suffixes.SuffixLevels, "strings", lambda self, text, place: laid.append(len(place)) or strings(self, text, place))
    which, string = suffixes.compare_suffixes(heads, 50)
    assert sorted(zip(which.tolist(), string.tolist(), strict=True)) == [(i, k) for i in range(1, n, 2) for k in range(6)]
    assert sum(laid) < 5 * 13 * n


def test_copies_of_whole_texts_send_no_contexts(spark, monkeypatch):
    r = random.Random(8)
    base, other = ("".join(r.choice("abcdefgh é") for _ in range(400)) for _ in range(2))
    made = [(i, base) for i in range(3, 33)] + [(3, base), (3, base + "x"), (9, base[:200] + other), (40, other), (41, other), (None, base)]
    sent, send = [], suffixes.contexts
    monkeypatch.setattr(suffixes, "contexts", lambda docs, *a: sent.append(sorted(x.doc_id for x in docs.select("doc_id").collect())) or send(docs, *a))
    got = suffixes.drop_repeats(spark.createDataFrame(rows(made), DOCS).repartition(3))
    assert Counter(map(tuple, got.collect())) == drop_strings(made, 50)
    assert sent == [[3, 3, 3, 9, 40]]
