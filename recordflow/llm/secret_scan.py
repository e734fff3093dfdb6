"""Operator 9: secret scans, with a random forest that removes false positives.

Candidates come from the whole text: tokens of known forms and PEM blocks, values
assigned to names such as token or password, and long strings that mix digits or cases
with letters.
A random forest judges each by its length, its transitions between characters, the
share of it that dictionary words cover, whether it looks like a path, and the words
around it. The forest is trained on labelled findings: (text before, value, text
after, secret or not). ``labelled_findings`` makes a seeded set of such, cut from made-up
texts as ``candidates`` cuts them: keywords, names, quotes or none of them on the left,
tokens of known forms, PEM blocks and loose lines of these. A bare hexadecimal string
without a keyword counts as a digest. A table of labelled findings can be given instead (``forest_of``),
of which at most ``MOST_FINDINGS``, those with the least hash, are learnt from.

Defined results: null and empty texts have no candidates; candidates are apart: of
overlapping ones a known form or PEM block stays whole, then an assigned value, and what
is left of a longer one on either side is a candidate if long enough; a finding's span is in bytes of the UTF-8 text; equal findings in
repeated rows are judged alike; very long texts are scanned whole, and long candidates by all their
windows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import string
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_view, light_batches

MOST_FINDINGS = 20_000
NEAR = 48  # bytes looked at on either side of a candidate
WINDOW = 256  # bytes of a candidate judged at once; a longer one counts as its most secret window
MASK = b"<secret>"
RESULT = "doc_id long, n_candidates long, n_secrets long, n_masked_bytes long, masked_sha256 string, findings array<struct<start:long,end:long,score:double>>"

# Forms of tokens that are published by those who issue them.
KNOWN_FORMS = [
    rb"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    rb"gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])",
    rb"xox[abprs]-[A-Za-z0-9-]{10,}",
    rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z])",
    rb"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
]
# Words beside secrets, and beside strings that only look like them.
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private"]
PLAIN_WORDS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "base64", "revision", "build", "version", "id", "image", "file", "path", "url", "href", "src", "isbn", "order", "invoice", "example", "sample"]
# Words that people build names and paths from.
DICTIONARY = """about access account action admin all and app archive article asset auth available back base bin blog body build button cache change check class client
code color com comment commit config content control core create css data date default demo description detail dev dir disable doc down dummy edit email enable end error event example
export false feature file find first font foo for form format from get group guide handler hash head help here home host html http icon image img import index info init insert
item java js json key lang last layout left lib link list local log login long main make manager map master max media menu message meta min model module name net new next node none not
null number object off on open option order org out page param password path php placeholder plugin post print private product profile project public query read redirect release remove report
request resource response result right root sample save search secret section select send server service session set short show site size source start state static status string style submit
switch table tag target temp template test text the theme this time title token top true type undefined update upload url user util value version video view web website window with word work www xml your""".split()

_KEYWORDS = b"|".join(w.encode() for w in sorted(SECRET_WORDS, key=len, reverse=True))
_ASSIGNED = re.compile(rb"(?i)(?:" + _KEYWORDS + rb")[a-z0-9_-]{0,16}[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"']?([^\s\"'<>;,]{8,})")
_USERINFO = re.compile(rb"[a-zA-Z][a-zA-Z0-9+.-]{1,15}://[^\s/:@\"'<>]{0,64}:([^\s/@\"'<>]{8,})@")  # of a URL: name and password
_LONG = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
_MIXED = re.compile(rb"[0-9]|[a-z][A-Z]")
_KNOWN = re.compile(b"|".join(KNOWN_FORMS))
_KNOWN_STARTS = re.compile(rb"AKIA|gh[pousr]_|xox[abprs]-|AIza|[sr]k_(?:live|test)_|eyJ")
_PEM_EDGE = re.compile(rb"-----(BEGIN|END) [A-Z0-9 ]+-----")
_PEM_BODY = re.compile(rb"(?:[A-Za-z0-9+/=:,. -]|\s|\\[nr])*")
_PEM_LINES = re.compile(rb"(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2}(?![^\s\\\"']))*")  # of a block without an end
_PRIVATE = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY")
_NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_-]*=(?=[^=])")
LEAST_ASSIGNED, LEAST_LONG = 8, 16  # bytes, as in the expressions above


def pem_blocks(text: bytes) -> list[tuple[int, int]]:
    """Spans of PEM blocks; one without an end goes as far as its lines do."""
    out, edges = [], list(_PEM_EDGE.finditer(text))
    for m, end in zip(edges, [*edges[1:], None], strict=False):
        if m[1] == b"BEGIN":
            whole = end is not None and end[1] == b"END" and _PEM_BODY.fullmatch(text, m.end(), end.start())
            out.append((m.start(), end.end() if whole else _PEM_LINES.match(text, m.end()).end()))
    return out


def assigned(text: bytes) -> list[tuple[int, int]]:
    """Spans of assigned values; a value ends where another assignment starts in it."""
    out, m = [], _ASSIGNED.search(text)
    while m:
        a, b = m.span(1)
        inner = _ASSIGNED.search(text, a, b)
        if inner:
            b = inner.start()
        if b - a >= LEAST_ASSIGNED:
            out.append((a, b))
        m = inner and _ASSIGNED.match(text, b) or _ASSIGNED.search(text, b)
    if b"://" in text:
        passwords = [m.span(1) for m in _USERINFO.finditer(text)]
        out = sorted(passwords + outside(out, passwords, LEAST_ASSIGNED))
    return out


def outside(spans: list[tuple[int, int]], taken: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """What is left of spans outside others, where it has so many bytes; both are in order and apart."""
    out, k = [], 0
    for a, b in spans:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < b:
            out.append((a, taken[j][0]))
            a, j = taken[j][1], j + 1
        out.append((a, b))
    return [(a, b) for a, b in out if b - a >= least]


def without_name(text: bytes, a: int, b: int) -> tuple[int, int]:
    """A long string without the name it is assigned to, if its value is long enough alone."""
    m = _NAME.match(text, a, b)
    return (m.end(), b) if m and b - m.end() >= LEAST_LONG and _MIXED.search(text, m.end(), b) else (a, b)


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Spans of candidates, in order and apart: known forms first, then assigned values, then long strings."""
    taken = pem_blocks(text)
    if _KNOWN_STARTS.search(text):
        known = [m.span() for m in _KNOWN.finditer(text)]
        whole = set(outside(known, taken, 1))
        taken = sorted(taken + [s for s in known if s in whole])
    taken = sorted(taken + outside(assigned(text), taken, LEAST_ASSIGNED))
    some = outside([m.span() for m in _LONG.finditer(text)], taken, LEAST_LONG)
    return sorted(taken + [without_name(text, a, b) for a, b in some if _MIXED.search(text, a, b)])


@cache
def _dictionary() -> frozenset[str]:
    return frozenset(DICTIONARY)


@cache
def _transitions() -> np.ndarray:
    """Log-odds of each pair of letters in dictionary words against evenly drawn ones."""
    n = np.ones((27, 27))
    for w in DICTIONARY:
        c = [26, *(ord(x) - 97 for x in w if "a" <= x <= "z"), 26]
        for a, b in zip(c, c[1:], strict=False):
            n[a, b] += 1
    return np.log(n / n.sum(axis=1, keepdims=True)) + np.log(27)


def covered_by_words(value: str) -> float:
    """Share of a value that dictionary words of three letters or more cover."""
    low, n, words = value.lower(), len(value), _dictionary()
    covered, at = 0, 0
    while at < n:
        for k in range(min(12, n - at), 2, -1):
            if low[at : at + k] in words:
                covered, at = covered + k, at + k
                break
        else:
            at += 1
    return covered / max(1, n)


def windows(value: bytes) -> list[bytes]:
    """Windows that cover a value, each half over the next."""
    last = max(0, len(value) - WINDOW)
    return [value[at : at + WINDOW] for at in [*range(0, last, WINDOW // 2), last]]


def characters(part: bytes) -> list[float]:
    """What the characters of a window are like."""
    v = part.decode("latin-1")
    kinds = ["d" if c in string.digits else "u" if c in string.ascii_uppercase else "l" if c in string.ascii_lowercase else "s" for c in v]
    letters = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in v.lower()]
    table = _transitions()
    pairs = [table[a, b] for a, b in zip(letters, letters[1:], strict=False) if a < 26 and b < 26]
    share = {k: kinds.count(k) / len(kinds) for k in "duls"}
    _, counts = np.unique(np.frombuffer(part, np.uint8), return_counts=True)
    p = counts / counts.sum()
    return [
        share["d"],
        share["u"],
        share["l"],
        share["s"],
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1),
        float(np.mean(pairs)) if pairs else 0.0,
        float(-(p * np.log2(p)).sum()),
        covered_by_words(v),
    ]


def surroundings(before: bytes, value: bytes, after: bytes) -> list[float]:
    """What form the whole candidate has, and what stands around it."""
    v = value.decode("latin-1")
    left, right = before[-NEAR:].decode("latin-1").lower(), after[:NEAR].decode("latin-1").lower()
    left_words = re.findall(r"[a-z0-9_-]+", left)[-4:]
    return [
        float(v.count("/") + v.count("\\")) / max(1, len(v)) * 10,
        float(bool(re.search(r"^[./~]|://|\.(?:js|css|png|jpe?g|gif|html?|php|py|java|txt|json|xml|svg|pdf)\b", v))),
        float(bool(re.search(r"https?:|www\.|@", left[-24:] + v))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", v.lower()))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", v))),
        float(any(w in x for x in left_words for w in SECRET_WORDS)),
        float(any(w in left_words[-1:] for w in PLAIN_WORDS)),
        float(left.rstrip("\"' \t")[-1:] in ("=", ":")),
        float(left[-1:] in "\"'" and right[:1] in "\"'"),
        float(right[:1] == "@" and bool(re.search(r"://[^\s/:@]*:$", left))),
        float(bool(_KNOWN.fullmatch(value) or _PRIVATE.match(value))),
    ]


def by_window(before: bytes, value: bytes, after: bytes) -> list[list[float]]:
    """Features of a candidate, once for each of its windows."""
    around = surroundings(before, value, after)
    return [[min(len(value), 512), *characters(w), *around] for w in windows(value)]


def features(before: bytes, value: bytes, after: bytes) -> list[float]:
    """Features by the first window."""
    return [min(len(value), 512), *characters(value[:WINDOW]), *surroundings(before, value, after)]


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[bytes, bytes, bytes, int]]:
    """Made-up findings with labels, cut by ``candidates``, half of them secrets; the same for each seed."""
    r = random.Random(seed)
    draw = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    lower, alnum = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits
    syllables = ["an", "er", "the", "in", "st", "re", "tion", "on", "ou", "le", "de", "en", "ich", "ung", "ado", "mente"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4))) if r.random() < 0.9 else f"mail@{r.choice(DICTIONARY)}.example.com"
    names = lambda k, join: join.join(r.choices(DICTIONARY, k=k))

    base64 = string.ascii_letters + string.digits + "+/"
    known = [
        lambda: "AKIA" + draw(string.ascii_uppercase + string.digits, 16),
        lambda: "gh" + r.choice("pousr") + "_" + draw(alnum, 36),
        lambda: "xoxb-" + "-".join([draw(string.digits, 12), draw(string.digits, 12), draw(alnum, 24)]),
        lambda: "AIza" + draw(alnum + "_-", 34) + r.choice(alnum),
        lambda: r.choice("sr") + "k_" + r.choice(["live", "test"]) + "_" + draw(alnum, r.randint(16, 40)),
        lambda: "eyJ" + ".".join(draw(alnum + "_-", r.randint(12, 90)) for _ in range(3)),
    ]
    lines = lambda: [draw(base64, 64) for _ in range(r.randint(2, 26))] + [draw(base64, r.randint(16, 60)) + r.choice(["", "=", "=="])]

    def block(what: str) -> str:
        join = r.choice(["\n", "\n", "\r\n", "\\n"])
        return join.join([f"-----BEGIN {what}-----", *lines(), *([f"-----END {what}-----"] if r.random() < 0.8 else [])])

    def bare() -> tuple[str, str, str]:
        """A secret that no keyword stands beside."""
        kind = r.random()
        if kind < 0.4:
            value = r.choice(known)()
        elif kind < 0.7:
            value = draw(alnum, r.randint(28, 64))
        else:
            value = draw(base64, r.randint(32, 88))
        quote = r.choice(['"', "'", "", "", ""])
        left = r.choice(["", f"{word()} ", f"{word()}\n", f"{word()} {r.choice(['key', 'KEY', 'k', 'value', 'signature', word()])}{r.choice(['=', '=', ': ', ' = '])}"])
        return left + quote, value, quote + r.choice(["", "\n", f" {word()}"])

    def private() -> tuple[str, str, str]:
        if r.random() < 0.7:
            return r.choice(["", f"{word()} {word()}\n"]), block(r.choice(["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY"), f"\n{word()}"
        part = lines()  # of a block whose edges aren't in the text
        return part[0] + "\n", part[1], "\n" + part[2]

    def secret() -> tuple[str, str, str]:
        kind = r.random()
        if kind < 0.2:
            return bare()
        if kind < 0.35:
            return private()
        if kind < 0.42:  # the password of a URL
            user = r.choice([word(), r.choice(DICTIONARY), "root", "admin"])
            return f"{word()} {r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp', 'mongodb+srv'])}://{user}:", draw(alnum + r.choice(["", "!#%&*", "-_."]), r.randint(10, 28)), f"@{r.choice(DICTIONARY)}.{r.choice(DICTIONARY)}.{r.choice(['com', 'org', 'internal'])}{r.choice(['', ':5432', '/db'])} {word()}"
        value = r.choice(
            [
                lambda: draw("0123456789abcdef", r.choice([32, 40, 40, 64])),
                lambda: draw("0123456789ABCDEF", r.choice([32, 40, 64])),
                lambda: draw(alnum, r.randint(16, 64)),
                lambda: draw(alnum + "+/_-", r.randint(20, 88)),
                *known[:2],
                r.choice(known),
                lambda: draw(alnum + "!#%&*", r.randint(10, 20)),
            ]
        )()
        name = r.choice(["token", "TOKEN", "secret", "api_key", "apiKey", "password", "PASSWORD", "access_key", "auth_token", "client_secret", "Bearer"])
        quote = r.choice(['"', '"', "'", ""])
        before = r.choice([f"{word()} {word()} ", f"{word()} {word()} ", f"{word()}\n", "export ", '{"', f"  {word()}: {word()}\n  ", f"{r.choice(DICTIONARY).upper()}_", f"?{word()}=1&"])
        if before == '{"':
            return before + name + r.choice(['": "', '":"']), value, '"' + r.choice(["}", ", ", ","]) + f'"{word()}": 1'
        return f"{before}{name}{r.choice([' = ', '=', ': ', ' := ', ' => '])}{quote}", value, quote + r.choice(["", "!!", "###", "\n", ";", ","]) + f" {word()}"

    def plain() -> tuple[str, str, str]:
        if r.random() < 0.08:
            return f"{word()}\n", block(r.choice(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST"])), f"\n{word()}"
        if r.random() < 0.08:
            return r.choice(["", f"{word()} {word()} ", f"{word()}\n"]), draw("0123456789abcdef", r.choice([32, 40, 40, 64])), r.choice(["", "\n", f" {word()}"])
        if r.random() < 0.08:
            return f"{word()} data:image/{r.choice(['png', 'gif', 'jpeg'])};base64,", draw(base64, r.randint(40, 400)) + r.choice(["", "=", "=="]), f'" {word()}'
        value, named = r.choice(
            [
                lambda: (draw("0123456789abcdef", r.choice([32, 40, 64])), True),
                lambda: (str(uuid.UUID(int=r.getrandbits(128))), True),
                lambda: (draw(string.digits, r.randint(16, 24)), False),
                lambda: (names(r.randint(3, 6), "/") + r.choice([".js", ".html", ".png", ""]), False),
                lambda: (names(r.randint(2, 5), r.choice(["_", "-", ""])) + draw(string.digits, r.randint(1, 4)), False),
                lambda: ("".join(x.capitalize() for x in r.choices(DICTIONARY, k=r.randint(3, 5))), False),
                lambda: (word() + word() + word() + r.choice(["A", "B"]) + word() + word(), False),
                lambda: (r.choice(["your", "my", "example", "changeme", "placeholder", "xxxxxxxx"]) + r.choice(["-", "_"]) + names(2, "_"), False),
                lambda: ("=" * r.randint(8, 20) + draw(string.digits, 2) + "-" * r.randint(8, 20), False),
                lambda: (f"{r.choice(['https', 'http'])}://{names(2, '.')}.com/{names(r.randint(1, 4), r.choice(['/', '-']))}{r.choice(['', '?id=' + draw(string.digits, 5)])}", False),
                lambda: (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z", False),
                lambda: (f"{names(1, '')}-{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{names(2, '-')}", False),
            ]
        )()
        name = r.choice(PLAIN_WORDS) if named else r.choice([*PLAIN_WORDS, word(), word(), word()])
        if not named and r.random() < 0.15:  # a placeholder where a secret would be
            name = r.choice(["token", "password", "secret"])
        quote = r.choice(['"', "'", "", ""])
        return f"{word()} {word()} {name}{r.choice([' ', ': ', '=', ' = '])}{quote}", value, quote + f" {word()}"

    out: list[tuple[bytes, bytes, bytes, int]] = []
    while len(out) < n:
        label = len(out) % 2
        before, value, after = (x.encode() for x in (secret() if label else plain()))
        text, start, end = before + value + after, len(before), len(before) + len(value)
        found = [(a, b) for a, b in candidates(text) if a < end and b > start]
        if found:
            a, b = max(found, key=lambda x: min(x[1], end) - max(x[0], start))
            out.append((text[max(0, a - NEAR) : a], text[a:b], text[b : b + NEAR], label))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, the two nodes below, and share of secrets."""

    trees: tuple[tuple[np.ndarray, ...], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, low, high, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= threshold[node], low[node], high[node])
            total += share[at]
        return total / max(1, len(self.trees))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 4, seed: int = 5) -> Forest:
    """A random forest: bootstrap samples, and at each node the best Gini cut of some features."""
    rng = np.random.default_rng(seed)
    some = max(1, int(np.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list[float]] = []
        todo = [(rows, 0, -1, 0)]
        while todo:
            own, level, parent, side = todo.pop()
            share = float(y[own].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes) - 1
            if level == depth or len(own) < 2 * least or share in (0.0, 1.0):
                continue
            best = None
            for f in rng.choice(x.shape[1], some, replace=False):
                order = np.argsort(x[own, f], kind="stable")
                v, t = x[own[order], f], np.cumsum(y[own[order]])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                cut = cut[(cut >= least) & (cut <= len(own) - least)]
                if not len(cut):
                    continue
                a, b = t[cut - 1] / cut, (t[-1] - t[cut - 1]) / (len(own) - cut)
                gini = cut * a * (1 - a) + (len(own) - cut) * b * (1 - b)
                k = int(np.argmin(gini))
                if best is None or gini[k] < best[0]:
                    best = (gini[k], f, (v[cut[k] - 1] + v[cut[k]]) / 2)
            if best is None:
                continue
            here = len(nodes) - 1
            nodes[here][:2] = [best[1], best[2]]
            left = x[own, best[1]] <= best[2]
            todo += [(own[left], level + 1, here, 0), (own[~left], level + 1, here, 1)]
        n = np.array(nodes)
        out.append((n[:, 0].astype(np.int64), n[:, 1], n[:, 2].astype(np.int64), n[:, 3].astype(np.int64), n[:, 4]))
    return Forest(tuple(out))


def _draw(finding: tuple[bytes, bytes, bytes, int]) -> bytes:
    return hashlib.blake2b(b"\0".join(finding[:3]), digest_size=8).digest()


def train_on(findings: Iterable[tuple[bytes, bytes, bytes, int]]) -> Forest:
    """A forest learnt from findings; of more than ``MOST_FINDINGS`` those with the least hash are taken."""
    some = [f for _, _, f in sorted(heapq.nsmallest(MOST_FINDINGS, ((_draw(f), i, f) for i, f in enumerate(findings))), key=lambda x: x[1])]
    return train(np.array([features(*f[:3]) for f in some]), np.array([f[3] for f in some], float))


def forest_of(findings: DataFrame) -> Forest:
    """A forest learnt from a table of findings: before, value, after (text or bytes) and secret (0 or 1).

    Rows without a value or a label are left out. At most ``MOST_FINDINGS`` rows, those with the least hash, reach the driver.
    """
    columns = [F.coalesce(F.col(c).cast("binary"), F.lit(b"")).alias(c) for c in ("before", "after")]
    own = findings.where("value is not null and secret in (0, 1)").select(*columns, F.col("value").cast("binary").alias("value"), F.col("secret").cast("int").alias("secret")).where(F.length("value") > 0)
    rows = own.orderBy(F.xxhash64("before", "value", "after"), "value", "before", "after", "secret").limit(MOST_FINDINGS).collect()
    if len({r["secret"] for r in rows}) < 2:
        raise ValueError("findings of both kinds are needed")
    return train_on((bytes(r["before"]), bytes(r["value"]), bytes(r["after"]), r["secret"]) for r in rows)


@cache
def default_forest() -> Forest:
    return train_on(labelled_findings())


def judged(text: bytes, forest: Forest) -> list[tuple[int, int, float]]:
    spans = candidates(text)
    if not spans:
        return []
    x, first = [], []
    for a, b in spans:
        first.append(len(x))
        x += by_window(text[max(0, a - NEAR) : a], text[a:b], text[b : b + NEAR])
    best = np.maximum.reduceat(forest.scores(np.array(x)), first)
    return [(a, b, float(s)) for (a, b), s in zip(spans, best, strict=True)]


def masked(text: bytes, findings: list[tuple[int, int, float]], least: float) -> bytes:
    out, at = [], 0
    for a, b, s in findings:
        if s >= least:
            out += [text[at:a], MASK]
            at = b
    return b"".join([*out, text[at:]])


def scan(docs: DataFrame, forest: Forest | None = None, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, candidates, secrets, masked bytes, SHA-256 of the masked text, and all findings with scores."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ["doc_id", "n_candidates", "n_secrets", "n_masked_bytes", "masked_sha256", "findings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for value in part.column("text").cast(pa.large_binary()):
                    text = value.as_py() or b""
                    found = judged(text, shared.value)
                    bad = [f for f in found if f[2] >= least]
                    rows.append((len(found), len(bad), sum(b - a for a, b, _ in bad), hashlib.sha256(masked(text, bad, least)).hexdigest(), [{"start": a, "end": b, "score": s} for a, b, s in found]))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.int64()) for v in c[:3]), pa.array(c[3]), pa.array(c[4], kind)], names)

    return documents_view(docs).mapInArrow(run, RESULT)


def mask_column(df: DataFrame, column: str = "text", forest: Forest | None = None, least: float = 0.5) -> DataFrame:
    """The table with secrets in a text column masked; all else as it is."""
    light_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(forest or default_forest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if v is None else masked(v, judged(v, shared.value), least) for v in part.column(i).cast(pa.large_binary()).to_pylist()]
                yield part.set_column(i, batch.schema.field(i), pa.array(texts, pa.large_binary()).cast(batch.schema.field(i).type))

    return df.mapInArrow(run, df.schema)


def with_lengths(df: DataFrame) -> DataFrame:
    """``n_chars`` as the length of ``text``, where the table has it."""
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in df.columns else df
