from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string, spans string, part int, key string"


def rows(texts):
    """Rows of documents, with columns whose names the operators use themselves."""
    return [(i, t, "en", "src0", None if t is None else len(t), "x", "y", 3, "z") for i, t in texts]


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages at all offsets, repeats inside a document, awkward texts and repeated rows."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(["an", "er", "the", "in", "st", "é", "ß", "re", "tion"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    passage, line = prose(140), prose(55)
    out = []
    for i in range(40):
        out.append(" ".join(prose(r.randint(0, 160))))
    base = prose(300)
    out += [" ".join(base)] * 5
    for _ in range(12):  # near copies, some only linked through others
        near = list(base)
        for _ in range(r.randint(1, 12)):
            near[r.randrange(300)] = word()
        at = r.randrange(300)
        near[at:at] = prose(r.randint(0, 3))
        out.append(" ".join(near))
    for _ in range(12):
        a, b = r.randint(0, 40), r.randint(60, 140)
        out.append(" ".join([*prose(r.randint(0, 70)), *passage[a:b], *prose(r.randint(0, 70))]))
    for _ in range(12):
        out.append("\n".join([" ".join(prose(r.randint(3, 30))), " ".join(line), " ".join(prose(r.randint(3, 30)))]))
    out += [" ".join(line * 4), " ".join(line * 4 + prose(9)), " ".join(["same"] * 200), " ".join(["same"] * 130)]
    out += [None, None, "", " \t\n ", "one", "One", "one two three four", "ONE two three FOUR", "a b c d e", "a b c d e f", "b c d e f", "\x00nul\x00 byte", "x" * 60, "y" + "x" * 60, "é" * 60, "z é" * 60]
    out.append(" ".join(prose(5000) + passage + prose(5000)))
    r.shuffle(out)
    made = list(enumerate(out, 100))
    made += [made[3], made[3], made[50], made[70]]  # repeated rows
    made += [(None, out[5]), (None, None), (None, " ".join(passage))]  # rows without an id
    return made


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS).repartition(5).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
