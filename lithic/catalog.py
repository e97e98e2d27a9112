"""One named query per operator of the inventory, each with its SQL twin for an outside engine.

`CATALOG[name] = (function(spark, directory) -> DataFrame, sql)`.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.money import cents, charge, day, packed_date, revenue, whole_quotient
from .operators import aggregate as A
from .operators import exchange as X
from .operators import join as J
from .operators import select as S
from .operators import sort as O
from .plans import tpch
from .sources import tables as T

CATALOG: dict[str, tuple] = {}

#: Ranges inside the dates of the supplied tables.
Q4_DATES = tpch.OrderPriority("1996-07-01", "1996-10-01")
Q5_DATES = tpch.LocalSupplier(start="1996-01-01", end="1997-01-01")
Q6_DATES = tpch.RevenueForecast("1996-01-01", "1997-01-01")

PRICE, DISC, TAX = (f"CAST(round({c} * 100) AS BIGINT)" for c in ("l_extendedprice", "l_discount", "l_tax"))


def entry(name: str, sql: str):
    def put(f):
        CATALOG[name] = (f, sql)
        return f

    return put


def line(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return T.load(spark, d, "lineitem", list(columns))


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder that the session names; a local one only where all executors are threads of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"file:///tmp/lithic-{os.getuid()}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


# --- sources and sinks


@entry("scan_project", "SELECT n_nationkey, n_name FROM nation")
def scan_project(spark, d):
    return T.load(spark, d, "nation", ["n_nationkey", "n_name"])


@entry("sink_roundtrip", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice FROM orders")
def sink_roundtrip(spark, d):
    path = work_dir(spark)
    orders = T.load(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    T.write(orders.withColumn("o_totalprice", cents("o_totalprice")), path, "o_orderkey bigint, o_totalprice bigint")
    return spark.read.parquet(path)


@entry("source_rows", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (2, 'c')) t(key, name)")
def source_rows(spark, d):
    return T.from_rows(spark, [(1, "a"), (2, "b"), (2, "c")], "key bigint, name string")


@entry("source_uniform", "SELECT CAST(10000 AS BIGINT) AS n, true AS within_range, CAST(50 AS BIGINT) AS keys")
def source_uniform(spark, d):
    keys = T.uniform(spark, 10_000, 1, 50)
    return keys.agg(F.count("key").alias("n"), ((F.min("key") == 1) & (F.max("key") == 50)).alias("within_range"), F.countDistinct("key").alias("keys"))


@entry("source_permutation", "SELECT range AS key FROM range(1, 1001)")
def source_permutation(spark, d):
    return T.permutation(spark, 1000)


# --- selection


@entry("filter_range_closed", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def filter_range_closed(spark, d):
    return S.select_where(line(spark, d, "l_orderkey", "l_quantity"), S.in_closed("l_quantity", 10, 20))


@entry("filter_range_halfopen", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30")
def filter_range_halfopen(spark, d):
    return S.select_where(line(spark, d, "l_orderkey", "l_quantity"), S.in_half_open("l_quantity", 10, 30))


@entry("filter_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30")
def filter_count(spark, d):
    return S.select_where(line(spark, d, "l_quantity"), S.in_half_open("l_quantity", 10, 30)).agg(F.count(F.lit(1)).alias("n"))


@entry("filter_date_before", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-15'")
def filter_date_before(spark, d):
    return S.select_where(T.load(spark, d, "orders", ["o_orderkey", "o_orderdate"]), S.before("o_orderdate", day("1996-03-15"))).select("o_orderkey")


@entry("filter_date_after", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-03-15'")
def filter_date_after(spark, d):
    return S.select_where(line(spark, d, "l_orderkey", "l_linenumber", "l_shipdate"), S.after("l_shipdate", day("2000-03-15"))).select("l_orderkey", "l_linenumber")


@entry("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def filter_date_range(spark, d):
    return S.select_where(T.load(spark, d, "orders", ["o_orderkey", "o_orderdate"]), S.in_half_open("o_orderdate", day("1996-01-01"), day("1997-01-01"))).select("o_orderkey")


@entry("filter_tolerance", f"SELECT l_orderkey, {DISC} AS disc FROM lineitem WHERE {DISC} BETWEEN 5 AND 7")
def filter_tolerance(spark, d):
    # Bounds on the raw column, looser than the exact test, reach the scan.
    rows = S.select_where(line(spark, d, "l_orderkey", "l_discount"), F.col("l_discount").between(0.045, 0.075))
    return S.select_where(rows.select("l_orderkey", cents("l_discount").alias("disc")), S.within("disc", 6))


@entry("filter_less", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 24")
def filter_less(spark, d):
    return S.select_where(line(spark, d, "l_orderkey", "l_quantity"), F.col("l_quantity") < 24)


@entry("filter_eq_string", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq_string(spark, d):
    return S.select_where(T.load(spark, d, "customer", ["c_custkey", "c_mktsegment"]), S.equals("c_mktsegment", "BUILDING")).select("c_custkey")


@entry("filter_contains", "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(c_mktsegment, 'UIL')")
def filter_contains(spark, d):
    return S.select_where(T.load(spark, d, "customer", ["c_custkey", "c_mktsegment"]), S.contains("c_mktsegment", "UIL"))


@entry("filter_col_vs_col", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey < l_linenumber")
def filter_col_vs_col(spark, d):
    return S.select_where(line(spark, d, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), S.less_column("l_suppkey", "l_linenumber")).drop("l_linenumber")


@entry("filter_conjunction", f"SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity < 24 AND {DISC} BETWEEN 5 AND 7")
def filter_conjunction(spark, d):
    rows = line(spark, d, "l_orderkey", "l_quantity", "l_discount", "l_shipdate")
    tests = S.in_half_open("l_shipdate", day("1996-01-01"), day("1997-01-01")), F.col("l_quantity") < 24, F.col("l_discount").between(0.045, 0.075), S.within(cents("l_discount"), 6)
    return S.select_where(rows, *tests).select("l_orderkey", "l_quantity")


# --- projection


@entry("project_product", "SELECT l_orderkey, l_partkey * l_suppkey AS product FROM lineitem")
def project_product(spark, d):
    return line(spark, d, "l_orderkey", "l_partkey", "l_suppkey").select("l_orderkey", (F.col("l_partkey") * F.col("l_suppkey")).alias("product"))


@entry("project_revenue", f"SELECT l_orderkey, {PRICE} * (100 - {DISC}) AS revenue FROM lineitem")
def project_revenue(spark, d):
    return line(spark, d, "l_orderkey", "l_extendedprice", "l_discount").select("l_orderkey", revenue(cents("l_extendedprice"), cents("l_discount")).alias("revenue"))


@entry("project_charge", f"SELECT l_orderkey, {PRICE} * (100 - {DISC}) * (100 + {TAX}) AS charge FROM lineitem")
def project_charge(spark, d):
    rows = line(spark, d, "l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    return rows.select("l_orderkey", charge(cents("l_extendedprice"), cents("l_discount"), cents("l_tax")).alias("charge"))


@entry("project_rename", "SELECT o_orderkey AS l_orderkey, o_custkey AS c_custkey FROM orders")
def project_rename(spark, d):
    return T.load(spark, d, "orders", ["o_orderkey", "o_custkey"]).withColumnsRenamed({"o_orderkey": "l_orderkey", "o_custkey": "c_custkey"})


@entry("project_quotient", "SELECT l_orderkey, l_partkey // (l_suppkey + 1) AS quotient FROM lineitem")
def project_quotient(spark, d):
    rows = line(spark, d, "l_orderkey", "l_partkey", "l_suppkey").withColumn("divisor", F.col("l_suppkey") + 1)
    return rows.select("l_orderkey", whole_quotient("l_partkey", "divisor").alias("quotient"))


@entry("project_rescale", f"SELECT l_orderkey, CAST({PRICE} * {DISC} AS DOUBLE) / 10000 AS amount FROM lineitem")
def project_rescale(spark, d):
    rows = line(spark, d, "l_orderkey", "l_extendedprice", "l_discount")
    return rows.select("l_orderkey", ((cents("l_extendedprice") * cents("l_discount")).cast("double") / 10000).alias("amount"))


@entry("project_packed_date", "SELECT o_orderkey, CAST(day(o_orderdate) + month(o_orderdate) * 32 + (year(o_orderdate) - 1900) * 512 AS INTEGER) AS packed FROM orders")
def project_packed_date(spark, d):
    return T.load(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", packed_date(F.col("o_orderdate")).alias("packed"))


# --- aggregation


@entry("reduce_sum", f"SELECT CAST(sum({PRICE}) AS BIGINT) AS total FROM lineitem")
def reduce_sum(spark, d):
    return A.reduce_sum(line(spark, d, "l_extendedprice"), cents("l_extendedprice"))


@entry("agg_sum", "SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey")
def agg_sum(spark, d):
    return A.sum_by(line(spark, d, "l_suppkey", "l_quantity"), F.col("l_quantity").cast("long"), "l_suppkey")


@entry("agg_count", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def agg_count(spark, d):
    return A.count_by(line(spark, d, "l_partkey"), "l_partkey")


@entry("agg_unique", "SELECT DISTINCT l_suppkey FROM lineitem")
def agg_unique(spark, d):
    return A.unique(line(spark, d, "l_suppkey"), "l_suppkey")


@entry("agg_mean", "SELECT l_returnflag, avg(CAST(l_quantity AS BIGINT)) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_mean(spark, d):
    return A.mean_by(line(spark, d, "l_returnflag", "l_quantity"), F.col("l_quantity").cast("long"), "l_returnflag")


@entry("agg_count_column", "SELECT l_linestatus, count(l_quantity) AS n FROM lineitem GROUP BY l_linestatus")
def agg_count_column(spark, d):
    return A.count_column_by(line(spark, d, "l_linestatus", "l_quantity"), "l_quantity", "l_linestatus")


@entry("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(spark, d):
    return A.count_distinct_by(line(spark, d, "l_returnflag", "l_orderkey"), "l_orderkey", "l_returnflag")


@entry("agg_dedupe_count", "SELECT o_orderpriority, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders) GROUP BY o_orderpriority")
def agg_dedupe_count(spark, d):
    return A.dedupe_then_count(T.load(spark, d, "orders", ["o_orderkey", "o_orderpriority"]), "o_orderkey", "o_orderpriority")


@entry("agg_multi_key", "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(sum(l_partkey) AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_multi_key(spark, d):
    rows = line(spark, d, "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
    return A.aggregate(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], F.sum("l_partkey").alias("total"), F.count(F.lit(1)).alias("n"))


@entry("agg_text_key", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def agg_text_key(spark, d):
    return A.count_by(T.load(spark, d, "orders", ["o_orderpriority"]), "o_orderpriority")


@entry("agg_sorted", "SELECT l_suppkey, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey")
def agg_sorted(spark, d):
    return A.aggregate_sorted(line(spark, d, "l_suppkey", "l_partkey"), ["l_suppkey"], F.sum("l_partkey").alias("total"))


# --- joins

ORDERS_OF_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def orders_of_lines(spark, d, strategy):
    lines, orders = line(spark, d, "l_orderkey", "l_linenumber", "l_partkey"), T.load(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return J.join(lines, orders, lines.l_orderkey == orders.o_orderkey, strategy=strategy).drop("o_orderkey")


for _strategy in ("auto", "hash", "merge", "broadcast"):
    entry("join_" + _strategy.replace("auto", "inner"), ORDERS_OF_LINES)(lambda spark, d, s=_strategy: orders_of_lines(spark, d, s))


@entry("join_composite_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 100 = s_suppkey")
def join_composite_key(spark, d):
    c, s = T.load(spark, d, "customer", ["c_custkey", "c_nationkey"]), T.load(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    return J.join(c, s, [c.c_nationkey == s.s_nationkey, c.c_custkey % 100 == s.s_suppkey]).select("c_custkey", "s_suppkey")


@entry("join_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi(spark, d):
    orders = T.load(spark, d, "orders", ["o_orderkey", "o_custkey"])
    large = S.select_where(line(spark, d, "l_orderkey", "l_quantity"), F.col("l_quantity") > 45)
    return J.semi_join(orders, large, orders.o_orderkey == large.l_orderkey)


@entry("join_bloom_prefilter", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey < 100")
def join_bloom_prefilter(spark, d):
    twin = J.bloom_session(spark, least_scan="0b")
    orders = S.select_where(T.load(twin, d, "orders", ["o_orderkey", "o_custkey"]), F.col("o_custkey") < 100).withColumnRenamed("o_orderkey", "l_orderkey")
    return J.join(line(twin, d, "l_orderkey", "l_linenumber"), orders, "l_orderkey", strategy="merge")


@entry("join_exact_prefilter", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey < 100")
def join_exact_prefilter(spark, d):
    orders = S.select_where(T.load(spark, d, "orders", ["o_orderkey", "o_custkey"]), F.col("o_custkey") < 100).withColumnRenamed("o_orderkey", "l_orderkey")
    lines = J.prefilter(line(spark, d, "l_orderkey", "l_linenumber"), orders, "l_orderkey")
    return J.join(lines, orders, "l_orderkey")


@entry("join_dimensions", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def join_dimensions(spark, d):
    region = S.select_where(T.load(spark, d, "region", ["r_regionkey", "r_name"]), S.equals("r_name", "ASIA"))
    nation, customer = T.load(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"]), T.load(spark, d, "customer", ["c_custkey", "c_nationkey"])
    dims = J.join(nation, region, nation.n_regionkey == region.r_regionkey, strategy="broadcast")
    return J.join(customer, dims, customer.c_nationkey == dims.n_nationkey, strategy="broadcast").select("c_custkey", "n_name", "r_name")


@entry("join_chain3", "SELECT c_custkey, o_orderkey, l_partkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING'")
def join_chain3(spark, d):
    customer = S.select_where(T.load(spark, d, "customer", ["c_custkey", "c_mktsegment"]), S.equals("c_mktsegment", "BUILDING"))
    orders, lines = T.load(spark, d, "orders", ["o_orderkey", "o_custkey"]), line(spark, d, "l_orderkey", "l_partkey")
    return J.join(lines, J.join(orders, customer, orders.o_custkey == customer.c_custkey), lines.l_orderkey == orders.o_orderkey).select("c_custkey", "o_orderkey", "l_partkey")


# --- order


@entry("sort_asc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey")
def sort_asc(spark, d):
    return O.order_by(T.load(spark, d, "orders", ["o_orderkey", "o_custkey"]), "o_orderkey")


@entry("sort_desc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC")
def sort_desc(spark, d):
    return O.order_by(T.load(spark, d, "orders", ["o_orderkey", "o_custkey"]), F.desc("o_orderkey"))


@entry("sort_multi", "SELECT l_suppkey, l_partkey, l_orderkey FROM lineitem ORDER BY ALL")
def sort_multi(spark, d):
    return O.order_by(line(spark, d, "l_suppkey", "l_partkey", "l_orderkey"), "l_suppkey", "l_partkey", "l_orderkey")


@entry("sort_local", "SELECT o_orderkey, o_custkey FROM orders")
def sort_local(spark, d):
    return O.sort_local(T.load(spark, d, "orders", ["o_orderkey", "o_custkey"]), "o_custkey")


@entry("top_k", "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders ORDER BY price DESC, o_orderkey LIMIT 10")
def top_k(spark, d):
    rows = T.load(spark, d, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", cents("o_totalprice").alias("price"))
    return O.top_k(rows, 10, F.desc("price"), "o_orderkey")


# --- placement

BY_SUPPLIER = "SELECT l_suppkey, count(*) AS n, CAST(1 AS BIGINT) AS parts FROM lineitem GROUP BY l_suppkey"


def one_part(placed: DataFrame) -> DataFrame:
    rows = X.with_partition(placed)
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))


@entry("partition_hash", BY_SUPPLIER)
def partition_hash(spark, d):
    return one_part(X.hash_partition(line(spark, d, "l_suppkey"), 16, "l_suppkey"))


@entry("partition_range", BY_SUPPLIER)
def partition_range(spark, d):
    return one_part(X.range_partition(line(spark, d, "l_suppkey"), 16, "l_suppkey"))


@entry("partition_even", "SELECT l_orderkey, l_linenumber FROM lineitem")
def partition_even(spark, d):
    return X.scatter(line(spark, d, "l_orderkey", "l_linenumber"), 16)


@entry("partition_replicate", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def partition_replicate(spark, d):
    s, n = T.load(spark, d, "supplier", ["s_suppkey", "s_nationkey"]), X.replicate(T.load(spark, d, "nation", ["n_nationkey", "n_name"]))
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name")


@entry("partition_gather", "SELECT r_regionkey, r_name FROM region")
def partition_gather(spark, d):
    return X.gather(T.load(spark, d, "region", ["r_regionkey", "r_name"]))


@entry("partition_salted", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def partition_salted(spark, d):
    rows = X.salted(line(spark, d, "l_returnflag", "l_orderkey"), 16, "l_orderkey")
    return A.sum_by(A.count_by(rows, "l_returnflag", "salt"), "n", "l_returnflag", name="n")


# --- the five queries


@entry("q1", f"""SELECT l_returnflag, l_linestatus, CAST(sum(qty) AS BIGINT) AS sum_qty, CAST(sum(price) AS BIGINT) AS sum_base_price,
CAST(sum(price * (100 - disc)) AS BIGINT) AS sum_disc_price, CAST(sum(price * (100 - disc) * (100 + tax)) AS BIGINT) AS sum_charge,
avg(qty) AS avg_qty, avg(price) AS avg_price, avg(disc) AS avg_disc, count(*) AS count_order
FROM (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS qty, {PRICE} AS price, {DISC} AS disc, {TAX} AS tax FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02')
GROUP BY ALL ORDER BY ALL""")  # fmt: skip
def q1(spark, d):
    sums = ("sum_qty", "sum_base_price", "sum_disc_price", "sum_charge")
    return tpch.q1(spark, d).withColumns({c: F.col(c).cast("long") for c in sums})


@entry("q3", f"""SELECT o_orderkey AS l_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 0 AS o_shippriority, CAST(sum({PRICE} * (100 - {DISC})) AS BIGINT) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY ALL ORDER BY revenue DESC, 2, 1 LIMIT 10""")  # fmt: skip
def q3(spark, d):
    return tpch.q3(spark, d).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@entry("q4", """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_orderkey * 7 + l_linenumber * 13) % 61 - 30 < 1 + (l_partkey * 11 + l_suppkey * 3) % 30)
GROUP BY ALL ORDER BY ALL""")  # fmt: skip
def q4(spark, d):
    return tpch.q4(spark, d, Q4_DATES)


@entry("q5", f"""SELECT n_name, CAST(sum({PRICE} * (100 - {DISC})) AS BIGINT) AS revenue
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name ORDER BY revenue DESC""")  # fmt: skip
def q5(spark, d):
    return tpch.q5(spark, d, Q5_DATES)


@entry("q6", f"""SELECT CAST(sum({PRICE} * {DISC}) AS DOUBLE) / 10000 AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity < 24 AND {DISC} BETWEEN 5 AND 7""")  # fmt: skip
def q6(spark, d):
    return tpch.q6(spark, d, Q6_DATES)
