"""Extraction cases, file round trips, and streams against their batch twins."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from boardstat.frames import literal_frame
from boardstat.operators import text as tx
from boardstat.plans import bindings as b
from boardstat.plans import catalog_text
from boardstat.schemas import Tables
from boardstat.operators.ingest import ingest_announcements
from boardstat.sources import files
from boardstat.streaming import ingest as stream
from boardstat.streaming.throttle import throttle_events, throttle_stream

from .conftest import SF


@pytest.mark.parametrize("text, want", [
    ("1,200 out of 2,000 (60.00%) made it", (1200, 2000, 60.0)),
    ("1,200 out of\n2,000 passed", (1200, 2000, 60.0)),
    ("1,200 passed and 800 failed out of 2,000", (1200, 2000, 60.0)),
    ("a passing rate of 61.5% meaning 1,200 out of 2,000 examinees", (1200, 2000, 61.5)),
    ("2,000 examinees and 1,200 passers or 60.1%", (1200, 2000, 60.1)),
    ("Total number of passers: 1,200. Number of examinees: 2,000", (1200, 2000, 60.0)),
    ("30 out of 20 (60%) and 10 out of 20 passed", (10, 20, 50.0)),
    ("30 out of 20 (60%) and so on", None),
    ("1 out of 2 (1.2.3%) then 10 passed and 10 failed out of 20", (10, 20, 50.0)),
    ("no numbers", None)])
def test_summary_wordings(spark, text, want):
    row = tx.extract_summary(literal_frame(spark, {"text": "string"}, [(text,)])).first()
    got = (row.total_passers, row.total_takers, row.pass_rate)
    assert got == (want or (None, None, None))


def test_table_layouts(spark):
    narrow = ("<table><tr><th>School</th></tr><tr><td>School</td><td>x</td><td>y</td><td>z</td></tr>"
              "<tr><td>May 2016</td><td>1</td><td>1</td><td>1</td></tr>"
              "<tr><td>A <b>College</b></td><td>1,000</td><td>900</td><td>90.00%</td></tr>"
              "<tr><td>B College</td><td>n/a</td><td>1</td><td>2</td></tr></table>")
    wide = ("<table><tr><td>h</td></tr><tr><td>1</td><td>C College</td>" + "<td>0</td>" * 8
            + "<td>3</td><td>1</td><td>4</td><td>75.00%</td></tr><tr><td>2<td>D College<td>1<td>1<td>2<td>50</table>")
    tiny = "<table><tr><td>x</td></tr></table>"
    pages = literal_frame(spark, {"page_id": "long", "html": "string"}, [(1, tiny + narrow), (2, wide), (3, tiny)])
    got = sorted(tuple(r) for r in tx.html_tables(pages).drop("region").collect())
    # The pieces of a cell are joined without a space.
    assert got == [(1, 1, "ACollege", 1000, 900, 90.0), (1, 2, "B College", None, None, None),
                   (2, 1, "C College", 4, 3, 75.0), (2, 2, "D College", 2, 1, 50.0)]


def test_header_lines_and_fallback(spark):
    text = "\n".join(["School A 1 2 3 4%", "UNIV OF CEBU 12 1 1 2 50.0% 0 0 0 0% 1 1 2 50.0%", "short",
                      "3 BIG SCHOOL 10 20 30 50.0%"])
    rows = tx.parse_school_reports(literal_frame(spark, {"doc_id": "long", "text": "string"}, [(1, text)])).collect()
    got = {(r.school, r.rank, r.passers, r.takers, r.source_no) for r in rows}
    assert ("UNIV OF CEBU", 1, 1, 2, 0) in got
    assert ("BIG SCHOOL", 3, 15, 30, 1) in got
    enough = tx.parse_school_reports(literal_frame(spark, {"doc_id": "long", "text": "string"}, [(1, text)]), 1).collect()
    assert {r.source_no for r in enough} == {0}


def test_report_blocks_of_two_cycles_stay_apart(spark, monkeypatch):
    rows = literal_frame(spark, {"exam_result_id": "long", "school_id": "long", "school": "string", "takers": "int", "passers": "int",
                                 "pass_rate": "double"}, [(101, 25_001, "B STATE 25001", 2, 1, 50.0), (102, 1, "A STATE 1", 2, 1, 50.0)])
    monkeypatch.setattr(catalog_text, "school_rows", lambda *_: rows)
    made = catalog_text.report_blocks(spark, SF).where("doc_id = 102000").collect()
    assert len(made) == 2
    got = tx.parse_school_reports(spark.createDataFrame(made)).where("source_no = 0").collect()
    assert {(r.school, r.line_no) for r in got} == {("B STATE CFAAB", 3), ("A STATE B", 3)}


def test_school_folder(spark, tmp_path):
    (tmp_path / "CELE_May_2019.csv").write_text("Rank,School Name,No. of Examinees,No. of Passers,Passing Rate\n"
                                                '1,"Univ, of Cebu","1,000",900,90.00%\n2, ,1,1,1\n')
    (tmp_path / "nov_2018.csv").write_text("%,passed,takers,institution,#\r\n50.0,1,2,Davao College,7\r\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    loaded, listing = files.read_csv_records(spark, str(tmp_path)), files.list_files(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in files.school_csv_rows(loaded).collect())
    assert rows == [("CELE_May_2019.csv", 2, "Univ, of Cebu", 1, 1000, 900, 90.0, "Region VII"),
                    ("nov_2018.csv", 2, "Davao College", 7, 2, 1, 50.0, "Region XI")]
    assert [r.file_name for r in files.school_file_errors(loaded).collect()] == ["other.csv"]
    cycles = {r.file_name: (r.month, r.year) for r in files.folder_cycles(listing).collect()}
    assert cycles == {"CELE_May_2019.csv": ("May", 2019), "nov_2018.csv": ("November", 2018), "other.csv": (None, None)}


def test_index_and_reports(spark, tmp_path):
    rows = [{"exam_code": "CELE", "year": 2019, "month": "May", "url": "u", "source": "prc.gov.ph",
             "discovered_via": "x", "post_id": 1, "title": "t"}, {"exam_code": "ALE", "year": 2018, "month": None}]
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(rows, indent=2))
    bad.write_text("{}")
    index = files.read_link_index(spark, str(good))
    assert index.count() == 2 and files.read_link_index(spark, str(good), "ALE").count() == 1
    with pytest.raises(ValueError):
        files.read_link_index(spark, str(bad))
    counts = files.write_link_index(index, str(tmp_path / "out"))
    assert {r.exam_code: r.links for r in counts.collect()} == {"CELE": 1, "ALE": 1}
    assert spark.read.option("header", True).csv(str(tmp_path / "out/national_links_csv")).count() == 2
    national, schools = b.national(spark, SF), b.schools(spark, SF)
    assert files.report("exams", national, 2026).count() == 25
    history = files.report("exam_history", national, 2026, "brand#1", years=7)
    assert {r.year for r in history.select("year").distinct().collect()} == {2019, 2020, 2021}
    for kind in ("rankings", "exam_top", "regions"):
        files.write_report(files.report(kind, schools, 2026, "BUILDING"), str(tmp_path / kind))
    with pytest.raises(ValueError):
        files.report("exam_top", schools, 2026)
    with pytest.raises(ValueError):
        files.report("other", schools, 2026)
    with pytest.raises(ValueError):
        files.write_report(history.limit(0), str(tmp_path / "none"))


def test_stream_ingest_equals_batch(spark, tmp_path):
    pages = catalog_text.arrivals(spark, SF).select("exam_code", "year", "month", "url", "source", "title", "html",
                                                    "arrival")
    t = b.registered(spark, SF)
    tables = Tables(programs=t.programs, exam_results=t.exam_results)
    columns = ["program_id", "month", "year", "total_takers", "total_passers", "pass_rate", "source_url"]
    batch = ingest_announcements(pages, tables).tables.exam_results.select(*columns)
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "cycles")
    pages.repartition(3, "exam_code").write.json(inbox)
    stream.start_snapshots(t.exam_results, target)
    query = stream.stream_ingest(spark, inbox, t.programs, target, str(tmp_path / "check"), files_per_batch=1)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last >= 1
    streamed = stream.snapshot(spark, target, last).select(*columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_stream_batches_write_what_changed(spark, tmp_path):
    pages = catalog_text.arrivals(spark, SF).select("exam_code", "year", "month", "url", "source", "title", "html",
                                                    "arrival")
    t = b.registered(spark, SF)
    inbox, target = str(tmp_path / "inbox"), str(tmp_path / "cycles")
    some = pages.orderBy("arrival").limit(60).collect()
    stream.start_snapshots(t.exam_results.where("id % 3 <> 0"), target)
    for k in range(6):
        spark.createDataFrame(some[10 * k:10 * k + 10], pages.schema).coalesce(1).write.mode("append").json(inbox)
        query = stream.stream_ingest(spark, inbox, t.programs, target, str(tmp_path / "check"), files_per_batch=1, compact_every=2)
        query.awaitTermination()
        number = query.lastProgress["batchId"]
        assert spark.read.parquet(f"{target}/changes/version={number}").count() <= 10
        assert stream.status(spark, target, number).count() == 10
        assert len(stream.versions(spark, f"{target}/base")) <= 2
        assert len(stream.versions(spark, f"{target}/changes")) <= 4
    batch = ingest_announcements(spark.createDataFrame(some, pages.schema),
                                 Tables(programs=t.programs, exam_results=t.exam_results.where("id % 3 <> 0")))
    columns = ["id", "program_id", "month", "year", "total_takers", "total_passers", "pass_rate", "source_url"]
    want, got = batch.tables.exam_results.select(columns), stream.snapshot(spark, target).select(columns)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def _events(spark):
    rows = [(k, t) for k in range(4) for t in ([0, 10, 10, 20, 1000, 1001, 1002, 2500, 9000] if k else range(0, 14000, 7))]
    start = 1_700_000_000_000
    return spark.createDataFrame(rows, "key long, ms long").select("key", F.timestamp_millis(F.col("ms") + start)
                                                                   .alias("ts"))


def _naive(rows, limit, window):
    out, state = {}, {}
    for key, at in sorted(rows):
        count, reset = state.get(key, (0, None))
        if reset is None or at > reset:
            count, reset = 0, at + window
        count += 1
        state[key] = (count, reset)
        allowed, rejected = out.get((key, at), (0, 0))
        out[(key, at)] = (allowed + (count <= limit), rejected + (count > limit))
    return out


def test_throttle_batch_and_stream(spark, tmp_path):
    events = _events(spark)
    raw = [(r.key, r.ms) for r in events.select("key", F.unix_millis("ts").alias("ms")).collect()]
    want = _naive(raw, 3, 1000)
    batch = throttle_events(events, 3, 1000)
    assert {(r.key, r.at_ms): (r.allowed, r.rejected) for r in batch.collect()} == want
    for slots in (1, 2, 3):
        cut = throttle_events(events, 3, 1000, slots=slots)
        assert {(r.key, r.at_ms): (r.allowed, r.rejected) for r in cut.collect()} == want
    big = throttle_events(events, 3, 1000, partners=[2])
    assert all(r.rejected == 0 for r in big.where("key = 2").collect())
    events.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "log"))
    live = throttle_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "log")), 3, 1000)
    query = (live.writeStream.format("memory").queryName("throttled").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert {(r.key, r.at_ms): (r.allowed, r.rejected) for r in spark.table("throttled").collect()} == want


def test_links_of_a_program_are_written_in_several_arrays(spark, tmp_path):
    rows = [("CELE", 2019, f"u{i}") for i in range(500)] + [(None, 2018, "v"), ("ALE", 2018, "w"), ("ALE", 2018, "w")]
    links = spark.createDataFrame(rows, "exam_code string, year int, url string")
    arrays = [json.loads(r.value) for r in catalog_text.link_arrays(links, most=50).collect()]
    assert 8 <= len(arrays) <= 12 and max(map(len, arrays)) <= 100
    assert all(len({x.get("exam_code") for x in a}) == 1 for a in arrays)
    catalog_text.link_arrays(links, most=50).write.option("maxRecordsPerFile", 1).text(str(tmp_path / "index"))
    back = files.read_link_index(spark, str(tmp_path / "index"))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted((tuple(r) for r in back.select("exam_code", "year", "url").collect()), key=key) == sorted(rows, key=key)


def test_wordings_are_linear(spark):
    """Texts of many numbers that begin a wording and never end one; a single pattern starts over at each."""
    texts = ["12 examinees " * 20_000, "1" * 200_000 + " out", "a passing rate of 5% " * 20_000, "total passers 9 " * 20_000,
             "3 out of 4 (" * 20_000, "12 elementary teachers out of 13 examinees (1%) " * 5_000]
    rows = literal_frame(spark, {"text": "string"}, [(t,) for t in texts]).repartition(6)
    start = time.perf_counter()
    assert tx.extract_summary(rows).where("total_takers is not null").count() == 0
    assert tx.extract_dual(rows).count() == 0
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("seed", range(3))
def test_wordings_equal_whole_patterns(spark, seed):
    """The parts of every wording found one after another against one pattern over the whole text."""
    draw = random.Random(seed)
    parts = ["5", "12,3", ",", "7.5%", "(50%)", "(5", "out of", "passed", "passed and", "failed out of", "passing rate of", "examinees",
             "passers", "total", "number of", "total passers:", "Total number of passers", "examinees: 9", "3 out of 4", "\n", "x", "6 passers"]
    texts = [" ".join(draw.choices(parts, k=draw.randrange(4, 40))) for _ in range(300)]
    whole = [((r"(?is)([\d,]+)\s+examinees.*?([\d,]+)\s+passers.*?([\d.]+)%"), (2, 1, 3), 4),
             ((r"(?is)passing\s+rate\s+of\s+([\d.]+)%.*?([\d,]+)\s+out\s+of\s+([\d,]+)"), (2, 3, 1), 3),
             ((r"(?is)total\s+(?:number\s+of\s+)?passers[:\s]+([\d,]+).*?examinees[:\s]+([\d,]+)"), (1, 2), 5),
             ((r"(?is)([\d,]+)\s+out\s+of\s+([\d,]+)\s+\(([\d.]+)%?\)"), (1, 2, 3), 0)]
    rows = literal_frame(spark, {"text": "string"}, [(t,) for t in texts])
    for pattern, groups, at in whole:
        wording = tx.WORDINGS[at]
        places = [g for g in wording[1:] if g]
        got = rows.select("text", tx._following(F.col("text"), wording[0], lambda *hits: F.array(
            *[F.regexp_extract(hits[part], wording[0][part], group) for part, group in places])).alias("found")).collect()
        for row in got:
            hit = re.search(pattern, row["text"])
            assert row["found"] == ([hit.group(g) for g in groups] if hit else None), row["text"]
