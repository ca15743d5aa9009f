"""Results that no cut may bend: wide files, far years, long decimals, all rows, and what jobs leave behind."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boardstat import frames
from boardstat.functions import numbers
from boardstat.operators import ingest, rankings, schools, search, writes
from boardstat.plans import bindings as b
from boardstat.schemas import Tables
from boardstat.sources import files
from boardstat.streaming import throttle

from .conftest import SF


def test_wide_and_quoted_school_files(spark):
    filler = ",".join(f"x{i}" for i in range(100))
    made = spark.createDataFrame([
        ("wide", f"{filler},Rank,School,Takers,Passers,Rate\n{',' * 100}7,ABC University,10,5,50%\n"),
        ("quoted", '"Rank, national","School ""Name""",Takers,Passers,Rate,Rank\r\n"1,2","A ""B"", C\nCollege",10,5,50%,3\r\n'),
        ("odd", 'Rank,School,Takers,Passers,Rate\n1,5" School,10,5,50\n'),
        ("lacking", '"a,b",School\n1,2\n')], "file_name string, content string")
    rows = {r["doc_id"]: (r["rank"], r["school"], r["takers"], r["passers"]) for r in files.school_csv_rows(made).collect()}
    assert rows["wide"] == (7, "ABC University", 10, 5)
    assert rows["odd"] == (1, '5" School', 10, 5)
    assert rows["quoted"] == (3, 'A "B", C\nCollege', 10, 5)
    assert {r["file_name"]: r["missing"] for r in files.school_file_errors(made).collect()} == {
        "lacking": "rank, takers, passers, pass_rate"}


def test_texts_that_come_in_another_order_when_read_again(spark):
    heads = ("Rank,School,Takers,Passers,Rate", "Rate,Passers,Takers,School,Rank")
    bodies = ("3,College,10,5,50%", "50%,5,10,College,3")
    made = spark.createDataFrame([(str(i), f"{heads[i % 2]}\n{bodies[i % 2]}\n") for i in range(60)], "file_name string, content string")
    moved = made.coalesce(1).mapInPandas(lambda batches: (batch.sample(frac=1) for batch in batches), made.schema)
    got = {tuple(r)[:7] for r in files.school_csv_rows(moved).collect()}
    assert got == {(str(i), 2, "College", 3, 10, 5, 50.0) for i in range(60)}


def test_quoted_header_and_line_break(spark):
    made = spark.createDataFrame([(
        "f", '"Notes, all",Rank,"School",Takers,Passers,"Pass ""Rate"""\r\n"a\r\nb",3,"A ""B"", C",10,5,50%\r\n')],
        "file_name string, content string")
    row = files.school_csv_rows(made).collect()[0]
    assert (row["rank"], row["school"], row["takers"], row["passers"], row["pass_rate"]) == (3, 'A "B", C', 10, 5, 50.0)


def test_national_files_of_different_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("exam_code,month,year,total_passers,total_takers,pass_rate\nCLE,May,2018,5,10,50\n")
    (tmp_path / "b.csv").write_text("exam_code,month,total_passers,total_takers,year,pass_rate\r\nCLE,May,5,10,2019,50\r\n")
    (tmp_path / "c.csv").write_text('\ufeffnote,source_url, pass_rate,year,"total_takers",total_passers,month,exam_code\n'
                                    '"a ""b"",\nc",http://x,50,2020,"1,000",500,May,CLE\n\n')
    rows = sorted(tuple(r) for r in files.read_national_csv(spark, str(tmp_path)).collect())
    assert rows == sorted([("CLE", "May", "2018", "5", "10", "50", None), ("CLE", "May", "2019", "5", "10", "50", None),
                           ("CLE", "May", "2020", "500", "1,000", "50", "http://x")], key=str)
    (tmp_path / "d.csv").write_text("exam_code,month,year\nCLE,May,2018\n")
    with pytest.raises(ValueError, match="d.csv"):
        files.read_national_csv(spark, str(tmp_path))


def test_records_are_the_same_in_one_split_and_in_many(spark, tmp_path):
    draw = random.Random(4)
    for k in range(3):
        rows = []
        for i in range(300):
            note = draw.choice(['""', '"two\nlines, ""quoted""\n\nend"', "plain", '"a, b"', '"' + "long\n" * 60 + '"'])
            rows.append(f"{i},{note},School {i},10,5,50%")
        stray = ['299,x,5" School,10,5,50'] if k else []
        text = "\n".join(["Rank,Note,School,Takers,Passers,Rate", *rows, *stray, "300,y,Last,1,1,100"])
        (tmp_path / f"f{k}.csv").write_text(text.replace("\n", "\r\n") if k == 2 else text)
        (tmp_path / f"f{k}.csv").touch()
    (tmp_path / "empty.csv").write_text("")

    def read():
        found = files.read_csv_records(spark, str(tmp_path))
        splits = found.sparkSession.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
        return splits, sorted(tuple(r)[1:] for r in found.collect())

    whole, expected = read()
    names, sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), {}
    for n in names:
        sizes[n] = spark.conf.get(n)
        spark.conf.set(n, "777")
    try:
        cut, got = read()
    finally:
        for n, v in sizes.items():
            spark.conf.set(n, v)
    assert whole == 3 and cut > 60 and got == expected
    plain = [(f"f{k}.csv", n, r) for k in range(3) for n, r in enumerate(csv_split((tmp_path / f"f{k}.csv").read_bytes().decode()), 1)]
    assert got == sorted(plain)
    rows = files.school_csv_rows(files.read_csv_records(spark, str(tmp_path))).collect()
    assert len(rows) == 3 * 301 + 2 and {r.school for r in rows} >= {'5" School', "School 7", "Last"}


def csv_split(text):
    """Records of a text: quotes in pairs hide line ends, a last one alone is plain."""
    text, out, at, quoted = text.replace("\r\n", "\n"), [], "", False
    stray = text.rfind('"') if text.count('"') % 2 else -1
    for i, c in enumerate(text):
        quoted ^= c == '"' and i != stray
        if c == "\n" and not quoted:
            out.append(at)
            at = ""
        else:
            at += c
    return [*out, at] if at else out


def test_years_far_apart_and_long_decimals(spark):
    programs = spark.createDataFrame([(1, "X", "X exam", "x")], "id long, exam_code string, name string, slug string")
    cycles = spark.createDataFrame([(i, 1, "May", y, 10, 5, 50.0, "u") for i, y in enumerate((1960, 2023, 2024, 2024))],
                                   "id long, program_id long, month string, year int, total_takers int, total_passers int, "
                                   "pass_rate double, source_url string")
    schools = spark.createDataFrame([(1, "S", "s", None)], "id long, name string, slug string, region_id long")
    regions = spark.createDataFrame([(1, "R", "r")], "id long, name string, code string")
    rows = spark.createDataFrame([(i, i, 1, 10, 5, 50.0, 1) for i in range(4)],
                                 "id long, exam_result_id long, school_id long, takers int, passers int, pass_rate double, rank int")
    tables = Tables(programs=programs, exam_results=cycles, schools=schools, regions=regions, school_performance=rows)
    assert rankings.aggregate_rankings(tables).first()["years_participated"] == 3
    rates = spark.createDataFrame([(50.00499,)] * 3, "x double")
    assert rates.agg(numbers.mean_rate(F.col("x"))).first()[0] == 50.0


def test_distribution_counts_every_rated_row(spark):
    t = b.schools(spark, SF)
    newest = rankings._school_rows(t, rankings._year_cycles(t, None, None)).where("pass_rate is not null")
    assert rankings.rate_distribution(t).agg(F.sum("schools")).first()[0] == newest.count()


def test_programs_of_one_page_keep_their_order(spark):
    current = b.registered(spark, SF).exam_results.limit(3)
    rows = spark.createDataFrame([(p, "May", 2031, 10, 5, 50.0, "u", 7) for p in (1000, 2, 999_999)],
                                 "program_id long, month string, year int, total_takers int, total_passers int, "
                                 "pass_rate double, source_url string, arrival long")
    new = writes.upsert_national(current, rows).where("year = 2031").orderBy("id").collect()
    assert [r["program_id"] for r in new] == [2, 1000, 999_999] and len({r["id"] for r in new}) == 3


def test_job_positions_and_blocks(spark):
    rows = spark.createDataFrame([(i, "A" if i % 10 < 5 else "B", 2020, "saved") for i in range(1, 101)],
                                 "line_no long, exam_code string, year int, status string")
    jobs = writes.import_job_islands(rows, block=3).orderBy("job_no").collect()
    assert [j["job_no"] for j in jobs] == list(range(1, len(jobs) + 1))
    assert [j["first_line"] for j in jobs] == sorted(j["first_line"] for j in jobs) and sum(j["rows"] for j in jobs) == 100


def test_equal_searches_are_answered_alike(spark):
    t = b.schools(spark, SF)
    queries = spark.createDataFrame([(1, "state"), (2, "STATE "), (3, "nope")], "query_id long, query string")
    found = search.global_search(t, queries).where("entity = 'school'").groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found}.keys() == {1, 2}
    assert len({r["count"] for r in found}) == 1


def test_a_job_leaves_nothing_but_its_output(spark):
    folder = frames.shared_folder(spark)
    app = f"{folder}/boardstat-{spark.sparkContext.applicationId}".removeprefix("file:")

    def held():
        return {os.path.join(d, x) for d, _, names in os.walk(app) for x in names if x.endswith(".parquet")}

    t = b.registered(spark, SF)
    cycles = t.exam_results.limit(10)
    before = held()
    with frames.scratch(spark):
        rows = writes.upsert_national(cycles, cycles.limit(2).withColumn("arrival", F.col("id")))
        assert rows.count() == 10 and held() > before
    assert held() == before


def test_log_rows_get_the_next_ids(spark):
    old = spark.createDataFrame([(5, "a")], "id long, action string")
    new = spark.createDataFrame([("c", 2), ("b", 1)], "action string, arrival long")
    got = {r["id"]: r["action"] for r in ingest.append_log(old, new).collect()}
    assert got == {5: "a", 6: "b", 7: "c"}


def test_one_busy_key_is_throttled_like_a_replay(spark):
    draw = random.Random(6)
    moments = [(1, draw.randrange(2_000_000)) for _ in range(6000)] + [(2, draw.randrange(9_000_000)) for _ in range(300)]
    expected, hits = [], Counter(moments)
    for key in (1, 2):
        count, reset = 0, None
        for at in sorted({m for k, m in moments if k == key}):
            n = hits[key, at]
            count, reset, allowed, rejected, retry = throttle._step(at, n, 3, 700, count, reset)
            expected.append((key, at, n, allowed, rejected, retry))
    frame = spark.createDataFrame(moments, "key long, at long").select("key", F.timestamp_millis("at").alias("ts"))
    for slots in (4, 256):
        got = throttle.throttle_events(frame, limit=3, window_ms=700, slots=slots).collect()
        assert sorted(tuple(r) for r in got) == sorted(expected)


def test_stretches_stay_whole_when_their_join_is_broadcast(spark):
    moments = [(key, at) for key in range(40) for at in range(0, 400, 10)]
    frame = spark.createDataFrame(moments, "key long, at long").repartition(8).select("key", F.timestamp_millis("at").alias("ts"))
    # As in a long log: the moments lie in several partitions and are too large to be broadcast, the entries are not.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "8k"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = throttle.throttle_events(frame, limit=3, window_ms=100).groupBy("key").agg(F.sum("allowed").alias("n")).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert {r["key"]: r["n"] for r in got} == {key: 12 for key in range(40)}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sums_of_schools_are_not_held_beside_the_sorted_lines(spark):
    above, below = _plan(b.school_counts(spark, SF)).split("Exchange hashpartitioning(c_mktsegment", 1)
    assert "HashAggregate" in above and "HashAggregate" not in below and "lineitem" in below


def test_lines_do_not_move_to_their_customers(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many customers
    try:
        below = _plan(b.school_counts(spark, SF)).split("Exchange hashpartitioning(o_custkey", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "orders.parquet" in below.split("FileScan", 2)[1]


def test_late_pages_read_their_blocks_only(spark):
    t = b.schools(spark, SF)
    many = t.schools.unionByName(t.schools.withColumn("id", F.col("id") + 1000).withColumn("name", F.concat("name", F.lit(" B"))))
    tables = Tables(schools=many, regions=t.regions)
    directory = schools.school_directory(tables, blocks=5)
    assert directory.select("block").distinct().count() == 5
    for search_text in (None, "state", "nothing at all"):
        for page in (1, 2, 4, 7, 9):
            want = schools.school_list(tables, search=search_text, page=page, per_page=3).collect()
            got = schools.school_page(tables, directory, search=search_text, page=page, per_page=3)
            assert got.collect() == want
    plan = schools.school_page(tables, directory, page=6, per_page=3)._jdf.queryExecution().toString()
    assert "block" in plan.split("PartitionFilters: [")[1].split("]")[0]
