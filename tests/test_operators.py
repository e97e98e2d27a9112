"""Plans, invariants and edge cases that SQL cannot see."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lithic.catalog import CATALOG
from lithic.functions.money import cents, day
from lithic.operators import aggregate as A
from lithic.operators import exchange as X
from lithic.operators import join as J
from lithic.operators import select as S
from lithic.operators import sort as O
from lithic.plans import timing, tpch
from lithic.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed(spark, rows):
    return spark.createDataFrame(rows, "key bigint, val bigint")


EDGE = [(0, 1), (4294967295, 2), (None, 3), (0, None), (7, 7)]


def test_strategies_agree_and_appear(spark):
    left, right = keyed(spark, [(i % 7, i) for i in range(50)] + EDGE), keyed(spark, [(i % 5, -i) for i in range(9)] + EDGE).withColumnRenamed("val", "other")
    want = None
    for strategy, node in (("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")):
        out = J.join(left, right, "key", strategy=strategy, limit=1 << 80)
        assert node in plan(out)
        rows = sorted(out.collect(), key=repr)
        assert want is None or rows == want
        want = rows
    assert not [r for r in want if r.key is None]


def test_broadcast_needs_a_small_side(spark):
    left = keyed(spark, EDGE)
    assert "broadcast" not in J.join(left, left.withColumnRenamed("val", "v2"), "key", strategy="broadcast", limit=0)._jdf.queryExecution().logical().toString()


def test_broadcast_goes_by_rows_not_by_files(spark, tmp_path):
    """Files of few bytes whose rows are many, or long."""
    spark.range(100_000).selectExpr("id div 50000 AS key", "7L AS other").coalesce(1).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(20).selectExpr("id AS key", "repeat('x', 100000) AS other").coalesce(1).write.parquet(f"{tmp_path}/long.parquet")
    left = keyed(spark, [(0, 1), (19, 2), (20, 3), (None, 4)])
    for name, rows in (("many", 50_000), ("long", 2)):
        right = T.load(spark, str(tmp_path), name)
        out = J.join(left, right, "key", strategy="broadcast", limit=1 << 20)
        assert "Broadcast" not in plan(out) and out.count() == rows
        assert T.estimated_bytes(right) <= 1 << 20 < T.table_bytes(right)
        assert "BroadcastHashJoin" in plan(J.join(left, right, "key", strategy="broadcast"))
        assert "Broadcast" not in plan(left.join(J.sized_broadcast(right, 1 << 20), "key"))
    assert T.table_bytes(keyed(spark, [])) == 0
    assert T.table_bytes(spark.sql("SELECT array(1, 2) AS a, 'x' AS a, CAST(NULL AS string) AS b")) > 0


def test_semi_join_keeps_one_row_each(spark):
    left = keyed(spark, [(1, 1), (2, 2), (None, 3)])
    assert [r.key for r in J.semi_join(left, keyed(spark, [(1, 0), (1, 0), (None, 0)]), "key").collect()] == [1]


def test_bloom_filter_is_planned(spark):
    df = CATALOG["join_bloom_prefilter"][0](spark, "/root/testdata/sf0.01")
    assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    assert df.count() == CATALOG["join_exact_prefilter"][0](spark, "/root/testdata/sf0.01").count() > 0


def test_hand_over_has_a_bound(spark):
    assert T.to_host(spark.range(5), 5).num_rows == 5
    with pytest.raises(ValueError):
        T.to_host(spark.range(6), 5)


def test_phases_are_collected(spark, tmp_path):
    seconds = timing.phases(spark.range(10))
    assert list(seconds) == [*timing.PHASES, "execution"] and seconds["execution"] > 0
    for name in ("a", "b"):
        timing.append_csv(str(tmp_path / "t.csv"), name, seconds)
    assert [x.split(",")[0] for x in (tmp_path / "t.csv").read_text().split()] == ["query", "a", "b"]


def test_filter_drops_null_and_keeps_order(spark):
    df = keyed(spark, [(i, i) for i in range(100)]).coalesce(1)
    assert [r.key for r in S.select_where(df, S.in_closed("key", 10, 20)).collect()] == list(range(10, 21))
    assert S.select_where(keyed(spark, EDGE), S.equals("val", 3)).count() == 1
    assert S.select_where(keyed(spark, []), S.in_half_open("key", 0, 1)).count() == 0


def test_aggregates_on_edges(spark):
    df = keyed(spark, EDGE)
    got = {r.key: r.n for r in A.count_by(df, "key").collect()}
    assert got == {0: 2, 4294967295: 1, None: 1, 7: 1}
    assert sorted(A.aggregate_sorted(df, ["key"], F.sum("val").alias("s")).collect(), key=repr) == sorted(A.aggregate(df, ["key"], F.sum("val").alias("s")).collect(), key=repr)
    assert A.reduce_sum(keyed(spark, []), F.col("val")).first().total is None
    assert {r.key: r.n for r in A.count_column_by(df, "val", "key").collect()}[0] == 1


def test_top_k_with_ties_and_few_rows(spark):
    df = keyed(spark, [(1, 5), (2, 5), (3, 5), (4, 9)])
    out = O.top_k(df, 3, F.desc("val"), "key")
    assert "TakeOrderedAndProject" in plan(out)
    assert [r.key for r in out.collect()] == [4, 1, 2]
    assert O.top_k(df, 10, "key").count() == 4


def test_range_partitions_are_disjoint_and_whole(spark):
    df = T.uniform(spark, 5000, 1, 1000, seed=3)
    parts = X.with_partition(X.range_partition(df, 8, "key")).groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("n")).orderBy("part").collect()
    assert sum(p.n for p in parts) == 5000
    assert all(a.hi < b.lo for a, b in zip(parts, parts[1:]))


def parts_of(df):
    return [[tuple(r) for r in p] for p in df.rdd.glom().collect()]


def test_even_split(spark):
    df = spark.range(0, 10_000, numPartitions=3).selectExpr("id AS key")
    sizes = [len(p) for p in parts_of(X.scatter(df, 16))]
    assert len(sizes) == 16 and sum(sizes) == 10_000 and max(sizes) - min(sizes) <= 16


def test_gather_is_one_partition_with_every_row(spark):
    parts = parts_of(X.gather(keyed(spark, EDGE).repartition(4)))
    assert len(parts) == 1 and sorted(parts[0], key=repr) == sorted(EDGE, key=repr)


def test_local_sort_moves_nothing(spark):
    df = T.permutation(spark, 1000, seed=5).repartition(4).cache()
    before, after = parts_of(df), parts_of(O.sort_local(df, "key"))
    assert after == [sorted(p) for p in before] and len(after) == 4


def test_sorted_aggregate_is_sorted_and_sums_first(spark):
    out = A.aggregate_sorted(T.uniform(spark, 5000, 1, 300), ["key"], F.count("key").alias("n"))
    assert "partial_count" in plan(out)
    assert all(p == sorted(p) for p in parts_of(out))


def test_bounds_reach_the_scan(spark):
    wide = spark.newSession()
    wide.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name in ("filter_tolerance", "filter_conjunction", "q6"):
        assert "GreaterThanOrEqual(l_discount" in plan(CATALOG[name][0](wide, "/root/testdata/sf0.001")), name


def test_entry_without_a_library():
    """One that only the training-data operators need."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q1' in q and 'pipeline' not in q and len(q) >= 60 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_global_sort(spark):
    keys = [r.key for r in O.order_by(T.permutation(spark, 500, seed=1), F.desc("key")).collect()]
    assert keys == list(range(500, 0, -1))


def test_fixtures_are_seeded(spark):
    assert T.uniform(spark, 100, 1, 50, 7).collect() == T.uniform(spark, 100, 1, 50, 7).collect()


def test_money_rounds_once(spark):
    assert spark.createDataFrame([(19.99,), (None,)], "x double").select(cents("x").alias("c")).collect()[0].c == 1999


def test_date_predicate_reaches_the_scan(spark):
    df = S.select_where(T.load(spark, "/root/testdata/sf0.001", "lineitem", ["l_shipdate", "l_orderkey"]), S.before("l_shipdate", day("1998-09-02")))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_shipdate" in text and "l_extendedprice" not in text


def test_real_receipt_dates_are_used_where_present(spark, tmp_path):
    d = dt.datetime(2000, 1, 1)
    rows = [(1, d, d + dt.timedelta(1)), (2, d, d)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_commitdate timestamp_ntz, l_receiptdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.l_orderkey for r in tpch.late_lines(spark, str(tmp_path)).collect()] == [1]


def test_reference_dates_run(spark):
    for f in (tpch.q4, tpch.q5, tpch.q6):
        f(spark, "/root/testdata/sf0.001").collect()


def test_goldens(spark):
    d = "/root/testdata/sf0.01"
    assert [r.order_count for r in tpch.q4(spark, d, tpch.OrderPriority("1996-07-01", "1996-10-01")).collect()] == [115, 108, 97, 123, 110]
    assert tpch.q6(spark, d, tpch.RevenueForecast("1996-01-01", "1997-01-01")).first().revenue == pytest.approx(4050706.2854)
    assert tpch.q3(spark, d).first().revenue == 5205421771
    assert tpch.q1(spark, d).first().sum_charge == 280824257597250
    wide = tpch.q1(spark, d, tpch.PricingSummary(wide=True)).first()
    assert int(wide.sum_charge) == 280824257597250
