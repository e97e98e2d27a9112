"""The five decision-support queries, one parameter class each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents, charge, day, revenue
from ..operators.join import join, semi_join
from ..operators.select import after, before, equals, in_half_open, select_where, within
from ..operators.sort import order_by, top_k
from ..sources.tables import load, with_optional


@dataclass(frozen=True)
class PricingSummary:
    shipped_before: str = "1998-09-02"
    #: Sums as decimal(38,0): sum_charge is scaled by 10^6 and leaves 64 bits near scale factor 300.
    wide: bool = True


@dataclass(frozen=True)
class ShippingPriority:
    segment: str = "BUILDING"
    date: str = "1995-03-15"
    rows: int = 10


@dataclass(frozen=True)
class OrderPriority:
    start: str = "1993-07-01"
    end: str = "1993-10-01"


@dataclass(frozen=True)
class LocalSupplier:
    region: str = "ASIA"
    start: str = "1994-01-01"
    end: str = "1995-01-01"


@dataclass(frozen=True)
class RevenueForecast:
    start: str = "1994-01-01"
    end: str = "1995-01-01"
    discount: int = 6
    quantity: int = 24


def q1(spark: SparkSession, directory: str, p: PricingSummary = PricingSummary()) -> DataFrame:
    line = load(spark, directory, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"])
    line = select_where(line, before("l_shipdate", day(p.shipped_before))).select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("qty"),
        cents("l_extendedprice").alias("price"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"),
    )

    def total(x: Column) -> Column:
        return F.sum(x.cast("decimal(38,0)") if p.wide else x)

    price, disc, tax = F.col("price"), F.col("disc"), F.col("tax")
    out = line.groupBy("l_returnflag", "l_linestatus").agg(
        total(F.col("qty")).alias("sum_qty"),
        total(price).alias("sum_base_price"),
        total(revenue(price, disc)).alias("sum_disc_price"),
        total(charge(price, disc, tax)).alias("sum_charge"),
        F.avg("qty").alias("avg_qty"),
        F.avg("price").alias("avg_price"),
        F.avg("disc").alias("avg_disc"),
        F.count("qty").alias("count_order"),
    )
    return order_by(out, "l_returnflag", "l_linestatus")


def q3(spark: SparkSession, directory: str, p: ShippingPriority = ShippingPriority()) -> DataFrame:
    customer = select_where(load(spark, directory, "customer", ["c_custkey", "c_mktsegment"]), equals("c_mktsegment", p.segment))
    orders = with_optional(load(spark, directory, "orders"), "o_shippriority", F.lit(0))
    orders = select_where(orders, before("o_orderdate", day(p.date))).select("o_orderkey", "o_custkey", "o_orderdate", "o_shippriority")
    line = select_where(load(spark, directory, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"]), after("l_shipdate", day(p.date)))
    joined = join(line, join(orders, customer, orders.o_custkey == customer.c_custkey), line.l_orderkey == orders.o_orderkey)
    out = joined.groupBy(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_shippriority").agg(
        F.sum(revenue(cents("l_extendedprice"), cents("l_discount"))).alias("revenue")
    )
    return top_k(out, p.rows, F.desc("revenue"), "o_orderdate", "l_orderkey")


def late_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Order keys of lines received after their commit date. Tables without those two dates get
    FIXTURE SYNTHESIS in their place: two offsets made from the line's keys, compared the same way."""
    line = load(spark, directory, "lineitem")
    if {"l_commitdate", "l_receiptdate"} <= set(line.columns):
        return select_where(line, F.col("l_commitdate") < F.col("l_receiptdate")).select("l_orderkey")
    commit = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 61 - 30
    receipt = (F.col("l_partkey") * 11 + F.col("l_suppkey") * 3) % 30 + 1
    return select_where(line, commit < receipt).select("l_orderkey")


def q4(spark: SparkSession, directory: str, p: OrderPriority = OrderPriority()) -> DataFrame:
    orders = load(spark, directory, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    orders = select_where(orders, in_half_open("o_orderdate", day(p.start), day(p.end)))
    kept = semi_join(orders, (late := late_lines(spark, directory)), orders.o_orderkey == late.l_orderkey)
    return order_by(kept.groupBy("o_orderpriority").agg(F.count("o_orderkey").alias("order_count")), "o_orderpriority")


def q5(spark: SparkSession, directory: str, p: LocalSupplier = LocalSupplier()) -> DataFrame:
    region = select_where(load(spark, directory, "region", ["r_regionkey", "r_name"]), equals("r_name", p.region))
    nation = load(spark, directory, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    nation = join(nation, region, nation.n_regionkey == region.r_regionkey, strategy="broadcast").select("n_nationkey", "n_name")
    customer = load(spark, directory, "customer", ["c_custkey", "c_nationkey"])
    customer = join(customer, nation, customer.c_nationkey == nation.n_nationkey, strategy="broadcast")
    orders = load(spark, directory, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    orders = select_where(orders, in_half_open("o_orderdate", day(p.start), day(p.end)))
    orders = join(orders, customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "n_nationkey", "n_name")
    # A supplier must be in the region as well: about four lines in five go before the large join.
    supplier = load(spark, directory, "supplier", ["s_suppkey", "s_nationkey"])
    supplier = join(supplier, nation.select(F.col("n_nationkey").alias("near")), F.col("s_nationkey") == F.col("near"), strategy="broadcast").drop("near")
    line = load(spark, directory, "lineitem", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"])
    line = join(line, supplier, line.l_suppkey == supplier.s_suppkey, strategy="broadcast")
    local = join(line, orders, [line.l_orderkey == orders.o_orderkey, F.col("s_nationkey") == F.col("n_nationkey")])
    out = local.groupBy("n_name").agg(F.sum(revenue(cents("l_extendedprice"), cents("l_discount"))).alias("revenue"))
    return order_by(out, F.desc("revenue"), "n_name")


def q6(spark: SparkSession, directory: str, p: RevenueForecast = RevenueForecast()) -> DataFrame:
    line = load(spark, directory, "lineitem", ["l_shipdate", "l_quantity", "l_discount", "l_extendedprice"])
    disc = cents("l_discount")
    # The two bare bounds on l_discount are looser than the exact test; they exist to reach the scan.
    near = F.col("l_discount").between((p.discount - 1.5) / 100, (p.discount + 1.5) / 100)
    kept = select_where(line, in_half_open("l_shipdate", day(p.start), day(p.end)), F.col("l_quantity") < p.quantity, near, within(disc, p.discount))
    return kept.agg((F.sum(cents("l_extendedprice") * disc).cast("double") / 10000).alias("revenue"))
