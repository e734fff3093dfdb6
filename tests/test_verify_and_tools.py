"""Checks with damaged output, the cost model, settings, the command line and streams."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from recordflow import cli, costmodel, report, shared
from recordflow.functions import record, text
from recordflow.operators import filters, runs, sorting, verify
from recordflow.report import Report
from recordflow.sources import generate, records
from recordflow.spec import RecordSpec, Settings, read_settings
from recordflow.streaming import streams

SMALL = RecordSpec(40)


@pytest.fixture
def sorted_output(spark, tmp_path):
    source = generate.generate(spark, 600, SMALL)
    path = tmp_path / "out"
    records.write_records(sorting.sort_distinct(source, "rec"), str(path))
    return source, path


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().split("\n")[:-1]]


def rewrite(path, rows):
    for f in path.glob("*"):
        f.unlink()
    for f in path.glob(".*"):
        f.unlink()
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:])):
        (path / f"part-{i:05d}.txt").write_text("".join(r + "\n" for r in part))


def both(spark, source, path):
    order = verify.verify_order(spark, str(path), SMALL)
    content = verify.verify_integrity(records.read_text_records(spark, str(path), SMALL), source)
    return verify.is_sound(order), verify.is_sound(content)


def test_sound(spark, sorted_output):
    source, path = sorted_output
    assert both(spark, source, path) == (True, True)
    assert verify.verify_order(spark, str(path), SMALL).first()["n_rows"] == 300


@pytest.mark.parametrize("damage", ["swap", "swap_files", "lose", "double", "corrupt"])
def test_damage(spark, sorted_output, damage):
    source, path = sorted_output
    rows = lines(path)
    assert len(rows) == 300
    if damage == "swap":
        rows[10], rows[11] = rows[11], rows[10]
    elif damage == "swap_files":
        rows = rows[150:] + rows[:150]
    elif damage == "lose":
        del rows[20]
    elif damage == "double":
        rows.insert(30, rows[30])
    else:
        rows[40] = rows[40][:20] + ("A" if rows[40][20] != "A" else "B") + rows[40][21:]
    rewrite(path, rows)
    want = {"swap": (False, True), "swap_files": (False, True), "lose": (True, False), "double": (True, False), "corrupt": (True, False)}[damage]
    assert both(spark, source, path) == want
    weak = verify.verify_subset(records.read_text_records(spark, str(path), SMALL), source).first()["missing"]
    assert weak == (1 if damage == "corrupt" else 0)  # the weak check sees neither lost nor doubled rows


def test_empty_output(spark, tmp_path):
    empty = generate.generate(spark, 0, SMALL)
    records.write_records(sorting.sort_distinct(empty, "rec"), str(tmp_path / "e"))
    assert both(spark, empty, tmp_path / "e") == (True, True)


def test_tier_geometry():
    got = {}
    for size in (20, 1000, 1024, 2048):
        t = costmodel.tiers(Settings(record_size=size))
        got[size] = [(t[k].page, t[k].capacity, t[k].input_area, t[k].output_area) for k in ("dram", "ssd")] + [t["hdd"].page]
    # values of the survey's table of tier geometry
    assert got == {
        20: [(204, 5_242_880, 4_980_660, 262_220), (1228, 536_870_912, 509_920_860, 26_950_052), 26_214],
        1000: [(4, 104_857, 99_560, 5_297), (24, 10_737_418, 10_198_440, 538_978), 524],
        1024: [(4, 102_400, 97_280, 5_120), (24, 10_485_760, 9_961_320, 524_440), 512],
        2048: [(2, 51_200, 48_640, 2_560), (12, 5_242_880, 4_980_660, 262_220), 256],
    }


def test_access_times():
    hdd = costmodel.tiers()["hdd"]
    assert hdd.access_seconds(100 << 20) == pytest.approx(1.005)
    assert hdd.access_seconds(4_997_775_360, truncate=True) == pytest.approx(47.005)
    assert hdd.access_seconds(4_997_775_360) == pytest.approx(47.667, abs=1e-3)
    assert costmodel.initial_runs(11_000_000) == 108
    with pytest.raises(ValueError):
        costmodel.check_sizes(Settings(record_size=1 << 20))


def test_settings(tmp_path):
    f = tmp_path / "s.conf"
    f.write_text("# sizes\nrecord_size = 100\nSEED=7\n\nssd_latency=0.5\n")
    s = read_settings(str(f))
    assert (s.record_size, s.seed, s.ssd_latency) == (100, 7, 0.5)
    f.write_text("nothing=1\n")
    with pytest.raises(ValueError):
        read_settings(str(f))


def test_integers(spark):
    df = spark.range(-20, 70).select("id", record.round_down("id", 8).alias("d"), record.round_up("id", 8).alias("u"), record.is_power_of_2("id").alias("p"), record.lowest_bit("id").alias("lo"), record.highest_bit("id").alias("hi"), record.is_odd("id").alias("o"), record.divide_up("id", 8).alias("c"))
    for r in df.collect():
        x = r["id"]
        assert r["d"] == x // 8 * 8 and r["u"] == -(-x // 8) * 8 and r["c"] == -(-x // 8) and r["o"] == (x % 2 == 1)
        assert r["p"] == (x > 0 and x & (x - 1) == 0)
        assert r["lo"] == ((x & -x).bit_length() - 1 if x else None) and r["hi"] == (x.bit_length() - 1 if x > 0 else None)
    assert record.bit_mask(5) == 31


def test_keys_of_bytes(spark):
    df = spark.createDataFrame([("ééééééééé",)], "rec string")
    assert len(df.select(record.key("rec").alias("k")).first()["k"]) == 8
    assert bytes(df.select(record.byte_key("rec").alias("k")).first()["k"]) == "éééé".encode()
    assert df.select(record.record_hash("rec").alias("h")).first()["h"] == df.select(F.xxhash64("rec").alias("h")).first()["h"]


def test_texts():
    assert [text.short_number(n) for n in (5, 12_345, 12_345_678)] == ["5", "12K", "12M"]
    assert text.size_text(1536) == "1.50 KB" and text.size_text(10) == "10 B"
    assert (text.yes_no(True), text.ok_bad(False)) == ("yes", "bad")
    assert text.progress(1, 2, 4) == "[##..] 50%" and text.progress(0, 0, 2) == "[##] 100%"


def test_runs(spark):
    df = spark.range(100).withColumn("v", 99 - F.col("id"))
    got = sorted(tuple(r) for r in runs.run_stats(df.select("v"), "v", 40, "v").collect())
    assert got == [(0, 0, 39, 40), (1, 40, 79, 40), (2, 80, 99, 20)]


def test_command_line(spark, tmp_path):
    a = ["-c", "100", "-s", "40", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "-o", str(tmp_path / "trace")]
    assert cli.main([*a, "-v"], spark) == 0
    told = json.loads((tmp_path / "trace").read_text().strip().split("\n")[-1])
    assert told["counts"] == {"n_input": 100, "n_output": 50, "duplicates_removed": 50}
    assert cli.main([*a, "-vo"], spark) == 0
    rewrite(tmp_path / "out", lines(tmp_path / "out")[::-1])
    assert cli.main([*a, "-vo"], spark) == 1
    assert cli.main(["-c", "5", "-s", "40", "-vo", "--input", str(tmp_path / "no"), "--output", str(tmp_path / "no"), "-o", str(tmp_path / "trace")], spark) == 2
    with pytest.raises(SystemExit):
        cli.main(["-c", "-1"], spark)


def test_report():
    r = Report()
    with r.timed("x"):
        pass
    r.sorted_rows(5, 3)
    assert json.loads(r.as_json())["counts"]["duplicates_removed"] == 2


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(f"r{i % 5}", f"2024-01-01 00:00:{i:02d}") for i in range(30)], "rec string, at string").select("rec", F.to_timestamp("at").alias("at")).write.parquet(str(src))
    stream = spark.readStream.schema("rec string, at timestamp").parquet(str(src))
    q = streams.distinct_within(stream, "at", "10 minutes", "rec").writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 5
    q = streams.windowed_groups(stream, "at", "1 minute", "10 seconds", ["rec"], F.count("*").alias("n")).writeStream.format("memory").queryName("groups").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("groups").agg(F.sum("n")).first()[0] == 30
    q = streams.write_sorted_batches(stream.select("rec"), str(tmp_path / "runs"), str(tmp_path / "cp"), "rec").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["rec"] for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [f"r{i}" for i in range(5)]


def test_violations_across_parts(spark):
    rows = [(i, (i * 7919) % 101 if i % 9 else None) for i in range(500)]
    values = [v for _, v in rows]
    want = sum(a > b for a, b in zip(values, values[1:], strict=False) if a is not None and b is not None)
    for parts in (1, 3, 16):
        assert verify.order_violations(spark.createDataFrame(rows, "i int, v int").repartition(parts), "v", "i").first()["violations"] == want
    text = spark.createDataFrame([(i, f"k{v}") for i, v in rows], "i int, v string")
    assert verify.order_violations(text, "v", "i").first()["violations"] == sum(f"k{a}" > f"k{b}" for a, b in zip(values, values[1:], strict=False))
    assert verify.order_violations(text.where("i < 0"), "v", "i").first()["violations"] == 0


def test_valid_to_the_last_byte(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("\nabc",), ("",), ("aB9",), ("é",), (None,)], "rec string")
    assert [r["rec"] for r in filters.filter_valid(df).collect()] == ["abc", "aB9"]
    assert [r["v"] for r in df.select(record.is_valid("rec").alias("v")).collect()] == [True, False, False, False, True, False, None]


def test_input_count_is_checked(spark, tmp_path, monkeypatch):
    """A sort that took in fewer records than asked for fails."""
    from recordflow import cli

    real = cli.open_or_generate
    monkeypatch.setattr(cli, "open_or_generate", lambda *a, **k: real(*a, **k).limit(20))
    assert cli.main(["-c", "30", "-s", "40", "--input", str(tmp_path / "i"), "--output", str(tmp_path / "o")], spark) == 3


def test_monitor(spark):
    with report.Monitor(spark, 0.05) as monitor:
        spark.range(3_000_000).selectExpr("sum(id * 3)").collect()
    assert monitor.summary()["n_samples"] == len(monitor.samples) >= 1 and monitor.summary()["most_driver_heap_bytes"] > 0
    with report.Monitor(spark, 0) as none:
        pass
    assert none.samples == []


def test_shared_folder_of_a_cluster(spark):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda name, default: default)})()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


def test_entry_without_a_dependency():
    """Where something that the optional part needs is absent, all else is there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; n = e.queries(); print('scan_count' in n, any(x.startswith('op') for x in n) or 'pipeline' in n)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.split() == ["True", "False"], out.stderr[-500:]
