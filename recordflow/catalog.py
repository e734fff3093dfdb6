"""Queries over the tables of a data folder, one for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import costmodel
from .functions import record
from .operators import filters, ordinals, runs, sorting, verify
from .shared import new_path
from .sources import generate, records
from .spec import RecordSpec
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _damaged(df: DataFrame, key: str) -> DataFrame:
    """A copy of the whole table with values lost, doubled, invented and repeated, for the checks to find."""
    k = F.col(key)
    changed = df.withColumn(key, F.when(k % 100 == 7, -k).when(k % 10 == 3, k - 1).otherwise(k))
    return changed.unionByName(changed.where(k % 50 == 1))


_DAMAGED_ONCE = "SELECT CASE WHEN o_orderkey % 100 = 7 THEN -o_orderkey WHEN o_orderkey % 10 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS k FROM orders"
_DAMAGED = f"(SELECT k FROM ({_DAMAGED_ONCE}) UNION ALL SELECT k FROM ({_DAMAGED_ONCE}) WHERE k % 50 = 1)"


@query("SELECT count(*) AS n_rows FROM lineitem")
def scan_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count("*").alias("n_rows"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || o_orderpriority AS rec, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key FROM orders")
def record_render(spark: SparkSession, d: str) -> DataFrame:
    rec = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", rec.alias("rec")).withColumn("key", record.key("rec"))


@query("SELECT doc_id, substr(text, 1, 8) AS key, CAST(length(text) AS BIGINT) AS n FROM documents")
def key_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", record.key("text").alias("key"), F.length("text").cast("long").alias("n"))


@query("SELECT c_custkey, c_name < c_mktsegment AS before, c_name > c_mktsegment AS after, c_name = c_mktsegment AS same FROM (SELECT c_custkey, substr(c_name, 1, 8) AS c_name, substr(c_mktsegment, 1, 8) AS c_mktsegment FROM customer)")
def comparators(spark: SparkSession, d: str) -> DataFrame:
    a, b = record.key("c_name"), record.key("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", record.key_before("c_name", "c_mktsegment").alias("before"), record.key_after("c_name", "c_mktsegment").alias("after"), record.same_record(a, b).alias("same"))


@query("SELECT o_orderkey, o_custkey, rn FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn % 2 = 1")
def filter_alternate(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_alternate(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", "rn")


@query("SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05")
def filter_where(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_where(table(spark, d, "lineitem"), "l_quantity < 24 and l_discount >= 0.05").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")


@query("SELECT c_custkey, regexp_full_match(c_name, '[0-9A-Za-z]+') AS name_valid, regexp_full_match(c_mktsegment, '[0-9A-Za-z]+') AS segment_valid FROM customer")
def key_valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", record.is_valid("c_name").alias("name_valid"), record.is_valid("c_mktsegment").alias("segment_valid"))


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS rn FROM customer")
def sort_full(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.with_ordinal(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")


@query("SELECT c_custkey, substr(c_mktsegment, 1, 8) AS key, row_number() OVER (ORDER BY substr(c_mktsegment, 1, 8), c_custkey) AS rn FROM customer")
def sort_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.with_ordinal(table(spark, d, "customer").select("c_custkey", record.key("c_mktsegment").alias("key")), "key", "c_custkey")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def sort_multi_desc(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.with_ordinal(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey")


_DISTINCT = "SELECT l_returnflag, l_linestatus, l_quantity, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_quantity) AS rn FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)"
_DISTINCT_COLUMNS = ("l_returnflag", "l_linestatus", "l_quantity")


@query(_DISTINCT)
def sort_distinct(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.with_ordinal(sorting.sort_distinct(table(spark, d, "lineitem"), *_DISTINCT_COLUMNS), *_DISTINCT_COLUMNS)


@query(_DISTINCT)
def sort_distinct_hash(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.with_ordinal(sorting.sort_distinct(table(spark, d, "lineitem"), *_DISTINCT_COLUMNS, mode="hash"), *_DISTINCT_COLUMNS)


@query(_DISTINCT)
def distinct_in_stream(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.with_ordinal(sorting.sort_distinct(table(spark, d, "lineitem"), *_DISTINCT_COLUMNS, mode="adjacent"), *_DISTINCT_COLUMNS)


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def distinct_text(spark: SparkSession, d: str) -> DataFrame:
    return sorting.sort_distinct(table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest")), "digest")


@query("SELECT doc_id, md5(text) AS digest FROM (SELECT doc_id, text, lag(text) OVER (ORDER BY text, doc_id) AS before FROM documents) WHERE before IS NULL OR before <> text")
def adjacent_distinct(spark: SparkSession, d: str) -> DataFrame:
    return runs.adjacent_distinct(table(spark, d, "documents"), "text", "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def duplicates_removed(spark: SparkSession, d: str) -> DataFrame:
    return sorting.duplicates_removed(table(spark, d, "documents"), "text")


@query("SELECT event_type, count(*) AS n_rows FROM events GROUP BY event_type")
def group_sorted_count(spark: SparkSession, d: str) -> DataFrame:
    return sorting.group_sorted(table(spark, d, "events"), ["event_type"], F.count("*").alias("n_rows"))


@query("SELECT event_type, count(*) AS n_rows, max(event_id) AS last_event FROM events GROUP BY event_type")
def group_in_stream(spark: SparkSession, d: str) -> DataFrame:
    return sorting.group_in_stream(table(spark, d, "events"), ["event_type"], F.count("*").alias("n_rows"), F.max("event_id").alias("last_event"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_sorted_sum(spark: SparkSession, d: str) -> DataFrame:
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return sorting.group_sorted(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_price"), F.count("*").alias("n_rows"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return sorting.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT DISTINCT l_quantity FROM lineitem ORDER BY l_quantity LIMIT 10")
def top_k_distinct(spark: SparkSession, d: str) -> DataFrame:
    return sorting.top_k_distinct(table(spark, d, "lineitem"), 10, "l_quantity")


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS rn FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P')")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    merged = sorting.merge_sorted(*(o.where(F.col("o_orderstatus") == s) for s in "FOP"), order=["o_orderkey"])
    return ordinals.with_ordinal(merged, "o_orderkey")


@query("SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS rn FROM (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' UNION SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def merge_runs_distinct(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")  # two runs that share rows and hold all between them
    merged = sorting.merge_sorted(*(o.where(F.col("o_orderstatus") != s).select("o_custkey") for s in "PF"), order=["o_custkey"], distinct=True)
    return ordinals.with_ordinal(merged, "o_custkey")


@query("SELECT CAST((rn - 1) // 1024 AS BIGINT) AS run_id, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n_rows FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_stats(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1024, "o_orderkey")


@query("SELECT coalesce(sum(CAST(before > o_orderkey AS BIGINT))::BIGINT, 0) AS violations FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS before FROM orders)")
def order_violations(spark: SparkSession, d: str) -> DataFrame:
    return verify.order_violations(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "o_orderkey")


@query("SELECT coalesce(sum(CAST(before > o_custkey AS BIGINT))::BIGINT, 0) AS violations FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders)")
def order_violations_unsorted(spark: SparkSession, d: str) -> DataFrame:
    return verify.order_violations(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query(f"SELECT count(*) AS missing FROM {_DAMAGED} WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def integrity_subset(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return verify.verify_subset(_damaged(o, "o_orderkey"), o, "o_orderkey")


@query("SELECT CAST(0 AS BIGINT) AS invented, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS doubled, count(*) AS n_source, count(*) AS n_output FROM orders")
def integrity_equal(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return verify.verify_integrity(o, o, "o_orderkey")


@query(f"""SELECT count(*) FILTER (o > 0 AND s = 0) AS invented, count(*) FILTER (o = 0 AND s > 0) AS lost, count(*) FILTER (o > 1) AS doubled, CAST(sum(s) AS BIGINT) AS n_source, CAST(sum(o) AS BIGINT) AS n_output
FROM (SELECT k, sum(o) AS o, sum(s) AS s FROM (SELECT k, 1 AS o, 0 AS s FROM {_DAMAGED} UNION ALL SELECT o_orderkey, 0, 1 FROM orders) GROUP BY k)""")
def integrity_damaged(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return verify.verify_integrity(_damaged(o, "o_orderkey"), o, "o_orderkey")


@query("SELECT CAST(l_orderkey % 16 AS BIGINT) AS part, count(*) AS n_rows FROM lineitem GROUP BY 1")
def hash_partitions(spark: SparkSession, d: str) -> DataFrame:
    return runs.hash_partitions(table(spark, d, "lineitem"), F.col("l_orderkey"), 16)


@query("""SELECT p_partkey, CAST(p_size - p_size % 7 AS INTEGER) AS down, CAST(p_size + 6 - (p_size + 6) % 7 AS INTEGER) AS up, CAST((p_size + 6) // 7 AS BIGINT) AS pieces,
p_size > 0 AND p_size & (p_size - 1) = 0 AS power, p_size % 2 = 1 AS odd, CAST(CASE WHEN p_size > 0 THEN length(bin(p_size)) - 1 END AS INTEGER) AS high, p_size BETWEEN 5 AND 20 AS inside FROM part""")
def math_helpers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", record.round_down("p_size", 7).alias("down"), record.round_up("p_size", 7).alias("up"), record.divide_up("p_size", 7).alias("pieces"), record.is_power_of_2("p_size").alias("power"), record.is_odd("p_size").alias("odd"), record.highest_bit("p_size").alias("high"), record.between("p_size", F.lit(5), F.lit(20)).alias("inside"))


@query("""SELECT name, n_rows, CAST((n_rows + 511) // 512 AS BIGINT) AS n_pages, 0.005 + CAST(n_rows AS DOUBLE) * 1024.0 / 104857600.0 AS seconds
FROM (SELECT 'lineitem' AS name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer)""")
def page_cost(spark: SparkSession, d: str) -> DataFrame:
    hdd = costmodel.tiers()["hdd"]
    counts = None
    for name in ("lineitem", "orders", "customer"):
        one = table(spark, d, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    n = F.col("n_rows")
    return counts.select("name", "n_rows", costmodel.pages(n, hdd.page).alias("n_pages"), costmodel.access_time(n, 1024, hdd.latency, hdd.bandwidth).alias("seconds"))


@query("""SELECT name, page, capacity, cluster, cluster * 95 AS input_area, capacity - cluster * 95 AS output_area, latency, bandwidth
FROM (SELECT name, page, capacity, capacity // 100 // page * page AS cluster, latency, bandwidth
FROM (SELECT name, CAST(ceil(floor(round(bandwidth * latency, 6)) / 4096) AS BIGINT) * 4096 // 1024 AS page, bytes // 1024 AS capacity, latency, bandwidth
FROM (VALUES ('dram', 0.000001::DOUBLE, 104857600::BIGINT, 104857600::BIGINT), ('ssd', 0.0001, 209715200, 10737418240), ('hdd', 0.005, 104857600, NULL)) AS t(name, latency, bandwidth, bytes)))""")
def tier_state(spark: SparkSession, d: str) -> DataFrame:
    """What the cost model knows of each tier, in records."""
    rows = [(t.name, t.page, t.capacity, t.cluster, t.input_area, t.output_area, t.latency, t.bandwidth) for t in costmodel.tiers().values()]
    return spark.createDataFrame(rows, "name string, page long, capacity long, cluster long, input_area long, output_area long, latency double, bandwidth long")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size <> 0 THEN length(bin(p_size & -p_size)) - 1 END AS INTEGER) AS low, CAST(p_partkey & 255 AS BIGINT) AS masked,
least(p_size, CAST(p_partkey % 50 AS INTEGER)) AS smaller, greatest(p_size, CAST(p_partkey % 50 AS INTEGER)) AS larger FROM part""")
def bit_helpers(spark: SparkSession, d: str) -> DataFrame:
    p, other = table(spark, d, "part"), (F.col("p_partkey") % 50).cast("int")
    return p.select("p_partkey", record.lowest_bit("p_size").alias("low"), F.col("p_partkey").bitwiseAND(F.lit(record.bit_mask(8))).alias("masked"), record.smaller("p_size", other).alias("smaller"), record.larger("p_size", other).alias("larger"))


def _order_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records of 24 bytes, the line feed included."""
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.rpad("o_orderpriority", 15, ".")).alias("rec"))


_ORDER_RECORDS = "(SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || rpad(o_orderpriority, 15, '.') AS rec FROM orders)"
ORDER_SPEC = RecordSpec(24)


def _record_files(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = new_path(spark, name)
    records.write_records(df, path)
    return path


@query(f"SELECT rec, substr(rec, 1, 8) AS key FROM {_ORDER_RECORDS}")
def record_text_scan(spark: SparkSession, d: str) -> DataFrame:
    return records.read_text_records(spark, _record_files(spark, _order_records(spark, d), "text-records"), ORDER_SPEC)


@query(f"SELECT lower(hex(encode(rec || chr(10)))) AS rec, substr(rec, 1, 8) AS key FROM {_ORDER_RECORDS}")
def record_binary_scan(spark: SparkSession, d: str) -> DataFrame:
    read = records.read_binary_records(spark, _record_files(spark, _order_records(spark, d), "binary-records"), ORDER_SPEC)
    return read.select(F.lower(F.hex("rec")).alias("rec"), F.col("key").cast("string").alias("key"))


@query(f"SELECT rec, row_number() OVER (ORDER BY rec) AS rn FROM (SELECT DISTINCT substr(rec, 5) AS rec FROM {_ORDER_RECORDS})")
def write_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Written as sorted, distinct files, joined to one file, and read again."""
    out = sorting.sort_distinct(_order_records(spark, d).select(F.substring("rec", 5, 19).alias("rec")), "rec")
    target = new_path(spark, "joined") + "/output.txt"
    records.join_files(spark, _record_files(spark, out, "sorted-records"), target)
    return ordinals.with_ordinal(records.read_text_records(spark, target, RecordSpec(20)).select("rec"), "rec")


@query(f"SELECT CAST((rn - 1) // 4096 AS BIGINT) AS run, min(rec) AS first_rec, max(rec) AS last_rec, count(*) AS n_rows FROM (SELECT rec, row_number() OVER (ORDER BY rec) AS rn FROM {_ORDER_RECORDS}) GROUP BY 1")
def sorted_run_files(spark: SparkSession, d: str) -> DataFrame:
    """Written as sorted runs, and read again in the order of the files."""
    path = new_path(spark, "runs")
    records.write_runs(_order_records(spark, d), path, 8)
    return runs.run_stats(spark.read.schema("rec string").parquet(path), "rec", 4096, "rec").select(F.col("run_id").alias("run"), F.col("first_key").alias("first_rec"), F.col("last_key").alias("last_rec"), "n_rows")


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS violations FROM orders")
def verify_order_files(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify_order(spark, _record_files(spark, sorting.sort_records(_order_records(spark, d), "rec"), "ordered-records"), ORDER_SPEC)


@query("SELECT count(*) AS n_rows, coalesce(sum(CAST(before > k AS BIGINT))::BIGINT, 0) AS violations FROM (SELECT k, lag(k) OVER (ORDER BY o_orderkey) AS before FROM (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS k FROM orders))")
def verify_order_unsorted_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in the order of another column, so that their keys are out of order."""
    out = table(spark, d, "orders").select("o_orderkey", F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.rpad("o_orderpriority", 15, ".")).alias("rec"))
    return verify.verify_order(spark, _record_files(spark, out.orderBy("o_orderkey"), "unordered-records"), ORDER_SPEC)


def _generated_sql(n: str, size: int, seed: int) -> str:
    """SQL for the records of the generator: the same arithmetic, by id and place."""
    p, q = generate.PRIMES
    batch = f"(CASE WHEN {n} <= 1 THEN 0 ELSE least(4096, {n}) // 2 * 2 END)"
    return f"""(WITH ids AS (SELECT id, CASE WHEN {batch} > 0 AND id < {n} // greatest({batch}, 1) * {batch} THEN id // 2 * 2 ELSE id END AS source FROM (SELECT unnest(range({n})) AS id)),
bases AS (SELECT id, ((source % {p}) * 48271 % {p} * 69621 + source // {p} * 40692 + {seed * 16807 + 1}) % {p} AS one, ((source % {p}) * 40014 % {q} * 39373 + source // {p} * 30323 + {seed * 45991 + 7}) % {q} AS two FROM ids)
SELECT id, string_agg(substr('{generate.ALPHABET}', CAST(y * y % {p} // CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 62 WHEN 2 THEN 3844 ELSE 238328 END % 62 AS INTEGER) + 1, 1), '' ORDER BY i) AS rec
FROM (SELECT id, i, (x * x + two * (i // 4 + 1)) % {q} AS y FROM (SELECT id, i, two, (one + i // 4 * 104729) % {p} AS x FROM bases, (SELECT unnest(range({size})) AS i))) GROUP BY id)"""


@query(f"SELECT id, rec, substr(rec, 1, 8) AS key FROM {_generated_sql('(SELECT count(*) FROM customer)', 39, 100)}")
def generated_records(spark: SparkSession, d: str) -> DataFrame:
    """As many records as there are customers."""
    return generate.generate(spark, table(spark, d, "customer").count(), RecordSpec(40))


@query("SELECT n AS n_rows, n - CASE WHEN n <= 1 THEN 0 ELSE n // (least(4096, n) // 2 * 2) * (least(4096, n) // 2) END AS n_distinct, n AS n_valid, CASE WHEN n > 0 THEN 31 END AS shortest, CASE WHEN n > 0 THEN 31 END AS longest FROM (SELECT count(*) AS n FROM orders)")
def generated_profile(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of generated records: pairs of duplicates, length and alphabet; as many as there are orders."""
    made = generate.generate(spark, table(spark, d, "orders").count(), RecordSpec(32))
    each = made.groupBy("rec").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.when(record.is_valid("rec"), F.col("n"))), F.lit(0)).alias("n_valid"), F.min(F.length("rec")).alias("shortest"), F.max(F.length("rec")).alias("longest"))


@query(f"SELECT DISTINCT rec FROM {_generated_sql('10000', 99, 100)}")
def generate_sort_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Generated records in pairs, sorted without duplicates."""
    return sorting.sort_distinct(generate.generate(spark, 10_000, RecordSpec(100)), "rec")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Line items as records, distinct and in order, with their position."""
    line = table(spark, d, "lineitem")
    rec = F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("string"))
    return ordinals.with_ordinal(sorting.sort_distinct(line.select(rec.alias("rec")), "rec"), "rec").withColumn("key", record.key("rec"))
