"""Generator, sources, sorts and sinks over the size matrix and awkward records."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recordflow.operators import filters, ordinals, sorting
from recordflow.plans.plan import RecordPlan
from recordflow.sources import generate, records
from recordflow.spec import RecordSpec

SIZES = [0, 1, 2, 3, 7, 10, 29, 100, 576, 1000]
SMALL = RecordSpec(40)


def recs(df):
    return [r["rec"] for r in df.collect()]


@pytest.mark.parametrize("n", SIZES)
def test_generated_sizes(spark, n):
    got = [r["rec"] for r in generate.generate(spark, n, SMALL).orderBy("id").collect()]
    assert len(got) == n and all(len(r) == 39 and r.isalnum() for r in got)
    assert n - len(set(got)) == generate.duplicate_pairs(n)
    size = generate.batch_size(n)
    assert all(got[i] == got[i + 1] for i in range(0, n // size * size if size else 0, 2))


def test_duplicate_counts():
    assert [generate.duplicate_pairs(n) for n in (0, 1, 7, 29, 576, 1000, 4096, 10_000)] == [0, 0, 3, 14, 288, 500, 2048, 4096]


def test_seed_decides(spark):
    one, two, other = (recs(generate.generate(spark.newSession(), 50, SMALL, seed=s).repartition(p)) for s, p in ((1, 2), (1, 5), (2, 2)))
    assert sorted(one) == sorted(two) and sorted(one) != sorted(other)


@pytest.mark.parametrize("mode", ["range", "hash", "adjacent"])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 576])
def test_sort_distinct(spark, n, mode):
    df = generate.generate(spark, n, SMALL)
    assert recs(sorting.sort_distinct(df, "rec", mode=mode)) == sorted(set(recs(df)))


def test_distinct_of_ties_and_nulls(spark):
    rows = [("k" * 8 + p, v) for p in "ABAB" for v in (1, None, 1)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "rec string, v int")
    for mode in ("range", "hash", "adjacent"):
        got = [tuple(r) for r in sorting.sort_distinct(df, "rec", "v", mode=mode).collect()]
        assert len(got) == 5 and set(got) == set(rows)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        sorting.sort_distinct(spark.range(1), mode="other")


def test_one_exchange(spark):
    df = generate.generate(spark, 100, SMALL)
    plan = sorting.sort_distinct(df, "rec")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    hashed = sorting.sort_distinct(df, "rec", mode="hash")._jdf.queryExecution().executedPlan().toString()
    assert hashed.count("Exchange") == 2


def test_metamorphic(spark):
    df = generate.generate(spark, 300, SMALL).select("rec")
    once = sorting.sort_distinct(df, "rec")
    want = recs(once)
    assert recs(sorting.sort_distinct(once, "rec")) == want
    assert recs(sorting.sort_distinct(df.union(df), "rec")) == want
    assert recs(sorting.sort_distinct(df.orderBy(F.rand(3)), "rec", parts=7)) == want


def test_tilde_and_all_same(spark):
    rows = ["~first", "~second", "plain"] + ["same"] * 500
    df = spark.createDataFrame([(r,) for r in rows], "rec string")
    assert recs(sorting.sort_distinct(df, "rec")) == sorted(set(rows))


def test_ordinals(spark):
    values = random.Random(4).sample(range(10_000), 2000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(9)
    got = [(r["v"], r["rn"]) for r in ordinals.with_ordinal(df, "v").collect()]
    assert sorted(got) == [(v, i) for i, v in enumerate(sorted(values), 1)]
    assert ordinals.with_ordinal(df.limit(0), "v").count() == 0
    assert [r["v"] for r in filters.filter_alternate(df, "v").orderBy("v").collect()] == sorted(values)[::2]


def test_valid(spark):
    df = spark.createDataFrame([("abcXYZ09",), ("has space",), ("",), ("é",), (None,)], "rec string")
    assert recs(filters.filter_valid(df)) == ["abcXYZ09"]


def test_text_round_trip(spark, tmp_path):
    df = generate.generate(spark, 1000, SMALL)
    want = sorted(set(recs(df)))
    out = str(tmp_path / "out")
    records.write_records(sorting.sort_distinct(df, "rec"), out)
    assert records.check_alignment(spark, out, SMALL.record_size) == len(want)
    total = records.join_files(spark, out, str(tmp_path / "one.txt"))
    data = (tmp_path / "one.txt").read_bytes()
    assert len(data) == total and data.decode().split("\n")[:-1] == want
    back = records.read_text_records(spark, str(tmp_path / "one.txt"), SMALL)
    assert sorted(recs(back)) == want and back.first()["key"] == back.first()["rec"][:8]


def test_binary_records(spark, tmp_path):
    rows = [bytes(random.Random(i).randrange(256) for _ in range(16)) for i in range(500)] + [b"same\0aaaaaaaaaaa", b"same\0bbbbbbbbbbb", b"\xff" * 16, b"\x7f" * 16]
    (tmp_path / "in.bin").write_bytes(b"".join(rows))
    df = records.read_binary_records(spark, str(tmp_path / "in.bin"), RecordSpec(16))
    assert [bytes(r["rec"]) for r in sorting.sort_distinct(df, "rec").collect()] == sorted(set(rows))
    (tmp_path / "cut.bin").write_bytes(b"x" * 33)
    with pytest.raises(ValueError):
        records.read_binary_records(spark, str(tmp_path / "cut.bin"), RecordSpec(16))


def test_open_or_generate(spark, tmp_path):
    path = str(tmp_path / "in")
    first = recs(generate.open_or_generate(spark, path, 20, SMALL))
    assert sorted(recs(generate.open_or_generate(spark, path, 20, SMALL, seed=9))) == sorted(first)
    with pytest.raises(ValueError):
        generate.open_or_generate(spark, path, 21, SMALL)


def test_spec():
    with pytest.raises(ValueError):
        RecordSpec(4)
    assert RecordSpec(8).text_size == 7


def test_groups_tops_merges(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "k int, v int")
    assert [tuple(r) for r in sorting.group_sorted(df, ["k"], F.sum("v").alias("s")).collect()] == [(k, sum(range(k, 30, 3))) for k in range(3)]
    assert sorted(tuple(r) for r in sorting.group_in_stream(df, ["k"], F.count("*").alias("n")).collect()) == [(0, 10), (1, 10), (2, 10)]
    assert [r["v"] for r in sorting.top_k(df, 3, F.desc("v")).collect()] == [29, 28, 27]
    assert [r["k"] for r in sorting.top_k_distinct(df, 2, "k").collect()] == [0, 1]
    merged = sorting.merge_sorted(df.where("k = 0"), df.where("k = 2"), df.where("k = 0"), order=["v"], distinct=True)
    assert [r["v"] for r in merged.collect()] == sorted([*range(0, 30, 3), *range(2, 30, 3)])
    assert sorting.duplicates_removed(df, "k").first().asDict() == {"n_rows": 30, "n_distinct": 3, "duplicates": 27}
    assert sorting.duplicates_removed(df.limit(0), "k").first()["n_rows"] == 0


def test_plan(spark, tmp_path):
    plan = RecordPlan.generated(spark, 200, SMALL)
    out = plan.sort_distinct()
    out.write(str(tmp_path / "p"))
    back = RecordPlan.scan(spark, str(tmp_path / "p"), SMALL)
    found = back.check_against(plan).first().asDict()
    assert (found["invented"], found["lost"], found["doubled"]) == (0, 0, 0)
    assert recs(out.top(3).frame) == recs(out.frame)[:3]
    assert plan.where("id < 10").alternate("id").frame.count() == 5
    assert plan.merge(plan, order=["rec"], distinct=True).frame.count() == 200
    assert plan.group(["key"], F.count("*").alias("n")).sort("key").frame.count() == out.frame.count()
