"""Staged tables are read by their partitions, and the dearest lines are found without joining all lines."""

import os

from pyspark.sql import functions as F

from boardstat import frames
from boardstat.operators import national, rankings
from boardstat.plans import bindings as b
from boardstat.plans import catalog

from .conftest import SF


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def partition_filters(frame):
    return [line for line in plan(frame).splitlines() if "PartitionFilters: [" in line and "PartitionFilters: []" not in line]


def test_years_are_partition_filters(spark):
    cycles = partition_filters(national.list_cycles(b.national(spark, SF), 2016, 2017))
    assert cycles and all("year" in line for line in cycles)
    assert b.national(spark, SF).exam_results.columns[:5] == ["id", "program_id", "exam_code", "month", "year"]


def test_rankings_of_a_year_read_its_cycles_only(spark):
    tables = b.schools(spark, SF)
    one = rankings.rankings(tables, year=2017, limit=1000)
    assert any("dynamicpruning" in line and "exam_result_id" in line for line in partition_filters(one))
    assert one.count() == tables.school_performance.join(
        tables.exam_results.where("year = 2017").select(F.col("id").alias("exam_result_id")), "exam_result_id").count() > 0


def test_least_price_keeps_the_dearest_lines(spark):
    schema = "c_mktsegment string, year int, half int, l_suppkey long, best double"
    rows = [("a", 2020, 1, k, float(k % 40)) for k in range(200)] + [("b", 2020, 2, k, 100.0 + k) for k in range(10)]
    assert b._least_price(spark.createDataFrame(rows, schema)) == 38.0
    assert b._least_price(spark.createDataFrame([*rows, ("c", 2021, 1, 1, 5.0)], schema)) is None
    short = [("b", 2020, 2, k, None if k == 3 else 1.0) for k in range(10)]
    assert b._least_price(spark.createDataFrame(short, schema)) is None
    assert b._least_price(spark.createDataFrame([], schema)) is None


def test_school_upsert_derives_no_top_examinees(spark, tmp_path):
    made = os.path.join(tmp_path, "tables")  # a path of its own: nothing is staged for it
    os.symlink(SF, made)
    assert catalog.QUERIES["upsert_school_rows"](spark, made).count() > 0
    staged = {name for _, name, source in frames._staged if source == made}
    assert "school_performance" in staged and "topnotchers" not in staged
    assert "best" not in frames._staged[(spark.sparkContext.applicationId, "school_counts", made)].columns


def test_lines_move_to_their_schools_as_one_number(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = plan(b.school_counts(spark, SF)).split("Exchange hashpartitioning(c_mktsegment", 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = moved[1].split("Project [", 1)[1].split("\n", 1)[0]
    assert " AS mark" in rows and "year(" not in rows and "half" not in rows.split(" AS mark")[1]
    assert "Exchange" not in moved[0]


def test_school_counts_keep_rows_without_date_flag_or_school(spark, tmp_path):
    tables = {
        "customer": (["c_custkey", "c_mktsegment"], [(1, "a"), (2, None)]),
        "orders": (["o_orderkey", "o_custkey", "date"], [(1, 1, "2001-06-30"), (2, 2, "2001-07-01"), (3, 1, None)]),
        "lineitem": (["l_orderkey", "l_suppkey", "l_returnflag"],
                     [(o, s, f) for o in (1, 2, 3) for s in (7, None) for f in ("R", "N", "N", None)])}
    for name, (columns, rows) in tables.items():
        made = spark.createDataFrame(rows, columns)
        if name == "orders":
            made = made.select("o_orderkey", "o_custkey", F.col("date").cast("timestamp").alias("o_orderdate"))
        made.write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, b.school_counts(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((*cycle, school, 4, 2) for cycle in (("a", 2021, 1), (None, 2021, 2), ("a", None, 2))
                          for school in (7, None)), key=str)


def test_floor_of_some_orders_keeps_the_dearest_lines(spark, monkeypatch):
    lines = b._segment_lines(spark, "/root/testdata/sf0.01", "l_extendedprice")
    counts = b.school_counts(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(b, "PROBED", 4)
    least = b._least_price(b._dearest_known(lines, counts))
    kept = lines.where(F.col("l_extendedprice") >= least).groupBy(*b.CYCLE).count()
    assert kept.count() == counts.select(*b.CYCLE).distinct().count() and kept.where(F.col("count") < b.TOP).count() == 0
    # A cycle that no probed order lies in has no floor, so nothing is left out.
    other = counts.limit(1).withColumn("year", F.lit(1900))
    assert b._least_price(b._dearest_known(lines, counts.unionByName(other))) is None
