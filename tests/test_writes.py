"""Upserts and precedence against a row-at-a-time replay; hot groups; idempotence."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boardstat.frames import number_rows, top_per_key
from boardstat.operators import ingest, rankings, search, writes
from boardstat.operators.ingest import _with_precedence
from boardstat.schemas import Tables

CYCLE = "id long, program_id long, month string, year int, total_takers int, total_passers int, pass_rate double, " \
        "source_url string"
ARRIVING = CYCLE.replace("id long, program", "arrival long, program")


def replay(current, incoming, force, compat):
    state = {(c[1], c[2], c[3]): c for c in current}
    for a in sorted(incoming):
        key, old = (a[1], a[2], a[3]), state.get((a[1], a[2], a[3]))
        if old and not force:
            manual, old_real, new_real = (old[7] or "").startswith("manual://"), (old[4] or 0) > 0, (a[4] or 0) > 0
            if manual and (compat or old_real or not new_real):
                continue
            if old_real and not new_real:
                continue
        state[key] = a
    return sorted((*k, v[4], v[7]) for k, v in state.items() for k in [tuple(str(x) for x in k)])


@pytest.mark.parametrize("force, compat", [(False, False), (False, True), (True, False)])
def test_upsert_national_replay(spark, force, compat):
    rng = random.Random(5)
    urls = ["manual://user-csv-national", "https://www.prc.gov.ph/a", "https://www.prcboard.com/b", None]

    def row(n, key):
        takers = rng.choice([0, None, 50, 60])
        return (n, key % 3, rng.choice(["May", None]) if key % 2 else "June", 2016 + key % 2, takers, 10, 20.0,
                rng.choice(urls))
    seen, current = set(), []
    for n in range(12):
        r = row(n + 1, n)
        if r[1:4] not in seen:
            seen.add(r[1:4])
            current.append(r)
    incoming = [row(n, rng.randrange(12)) for n in range(300)]
    got = writes.upsert_national(spark.createDataFrame(current, CYCLE), spark.createDataFrame(incoming, ARRIVING), force,
                                 compat)
    rows = got.collect()
    assert sorted((str(r.program_id), str(r.month), str(r.year), r.total_takers, r.source_url) for r in rows) == replay(
        current, incoming, force, compat)
    assert len({r.id for r in rows}) == len(rows)
    kept = {tuple(c[1:4]): c[0] for c in current}
    assert all(kept[(r.program_id, r.month, r.year)] == r.id for r in rows if (r.program_id, r.month, r.year) in kept)


def test_upsert_twice_is_once(spark):
    cur = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "id long, k string, v int")
    inc = spark.createDataFrame([(9, None, 5, 1), (9, "b", 6, 2), (9, "b", 7, 3)], "id long, k string, v int, arrival long")
    once = writes.upsert(cur, inc, ["k"])
    twice = writes.upsert(once, inc, ["k"])
    want = [(None, 5), ("a", 1), ("b", 7)]
    assert sorted(((r.k, r.v) for r in once.collect()), key=str) == sorted(want, key=str)
    assert sorted(((r.k, r.v) for r in twice.collect()), key=str) == sorted(want, key=str)
    kept = writes.upsert(cur, inc, ["k"], "ignore")
    assert sorted(((r.k, r.v) for r in kept.collect()), key=str) == sorted([(None, 2), ("a", 1), ("b", 6)], key=str)


def test_precedence_replay(spark):
    """Acceptance decided from first arrivals equals the decision of a loader that keeps the row it last stored."""
    rank = {"manual://user-csv-national": 5, "prc.gov.ph": 3, "prcboard.com": 2, "prcboard.com/direct": 1, "other": 0}
    urls = {"manual://user-csv-national": "manual://user-csv-national", "prc.gov.ph": "https://www.prc.gov.ph/x",
            "prcboard.com": "https://www.prcboard.com/x", "prcboard.com/direct": "https://www.prcboard.com/y",
            "other": "https://example.org/z"}
    stored = {"manual": 5, "gov": 3, "board": 2, "example": 0}
    rng = random.Random(7)

    def decide(state_url, source):
        if not state_url:
            return True
        if state_url.startswith("manual://"):
            return False
        if "prc.gov.ph" in state_url and "prc.gov.ph" not in source:
            return False
        old = next((v for k, v in stored.items() if k in state_url.replace("prc.gov.ph", "gov")), 0)
        return rank[source] >= old
    current, incoming, want = [], [], {}
    for key in range(60):
        state = None
        if key % 3:
            source = rng.choice(list(urls))
            takers = rng.choice([0, 10])
            current.append((key + 1, key, None, 2016, takers, 1, 1.0, urls[source]))
            state = urls[source] if takers else None
        for _ in range(rng.randrange(1, 9)):
            source, at = rng.choice(list(urls)), len(incoming)
            incoming.append((at, key, None, 2016, 10, 1, 1.0, urls[source], source))
            want[at] = decide(state, source)
            if want[at]:
                state = urls[source]
    got = _with_precedence(spark.createDataFrame(incoming, ARRIVING + ", source string"),
                           spark.createDataFrame(current, CYCLE), compat=False)
    assert {r.arrival: r.accepted for r in got.collect()} == want


def test_number_rows_with_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
                                  .alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = number_rows(df, ["k"], [F.desc("v")], "n").collect()
    groups: dict[str, list] = {}
    for r in got:
        groups.setdefault(r.k, []).append((r.n, r.v))
    assert sum(map(len, groups.values())) == 5000
    for rows in groups.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        assert [v for _, v in rows] == sorted((v for _, v in rows), reverse=True)


def test_numbered_rows_move_once(spark):
    numbered = number_rows(spark.range(5000).withColumn("k", F.col("id") % 3), ["k"], [F.desc("id")], "n")
    assert numbered.count() == numbered.select("k", "n").distinct().count() == 5000
    assert "Exchange hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert number_rows(spark.range(0), [], [F.asc("id")], "n").count() == 0


def test_top_of_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), "id",
                                  (F.col("id") * 7919 % 500).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    plain = top_per_key(df, ["k"], order, 200).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, top_per_key(df, ["k"], order, 200, spread="id").collect()))
    assert len(plain) == 400


def test_containing_pairs_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "state", "university", "of", "cebu", "a", "main", "st", "xy z"]
    patterns = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(40)} | {"a", "ü"})
    texts = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in range(60)} | {"zü b"})
    got = search.containing_pairs(spark.createDataFrame([(p,) for p in patterns], "pattern string"),
                                  spark.createDataFrame([(t,) for t in texts], "text string"))
    assert Counter((r.pattern, r.text) for r in got.collect()) == Counter(
        (p, t) for p in patterns for t in texts if p in t)


def test_job_islands_across_blocks(spark):
    groups = ["A", "A", "B", "A", "A", "A", "C", "C", "A"]
    rows = [(i + 1, g, 2016, "saved" if i % 2 else "skipped") for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "line_no long, exam_code string, year int, status string")
    got = [tuple(r) for r in writes.import_job_islands(df, block=2).orderBy("job_no").collect()]
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(1, "A", 1, 2), (2, "B", 3, 1), (3, "A", 4, 3), (4, "C", 7, 2),
                                                       (5, "A", 9, 1)]


def test_school_resolution(spark):
    schools = spark.createDataFrame([(1, "University of Cebu", "university-of-cebu", 7), (2, "Mapua", "mapua", 1)],
                                    "id long, name string, slug string, region_id long")
    regions = spark.createDataFrame([(6, "Western Visayas", "Region VI"), (7, "Central Visayas", "Region VII"),
                                     (1, "National Capital Region", "NCR")], "id long, name string, code string")
    rows = spark.createDataFrame([
        ("UNIVERSITY OF CEBU - Main Campus", None, 1), ("St. Mary College", "Region VI", 2),
        ("St Mary, College", "NCR", 3), ("", None, 4), ("Mapua", "NCR", 5)], "school string, region string, arrival long")
    dimension, mapping = writes.resolve_schools(schools, regions, rows)
    made = {r.name: (r.id, r.slug, r.region_id) for r in dimension.collect()}
    assert made["St. Mary College"] == (3, "st-mary-college", 6)
    assert len(made) == 3
    ids = {r.clean_name: r.school_id for r in mapping.collect()}
    assert ids == {"University Of Cebu": 1, "St. Mary College": 3, "St Mary, College": 3, "Mapua": 2}


def test_limit_comes_before_the_filters(spark):
    programs = spark.createDataFrame([(1, "P", "P", "p")], "id long, exam_code string, name string, slug string")
    regions = spark.createDataFrame([(1, "North", "N")], "id long, name string, code string")
    schools = spark.createDataFrame([(i, f"School {i}", f"s{i}", 1 if i == 3 else None) for i in range(1, 5)],
                                    "id long, name string, slug string, region_id long")
    results = spark.createDataFrame([(9, 1, "May", 2019, 10, 5, 50.0, None)], CYCLE)
    perf = spark.createDataFrame([(i, 9, i, 5, 3, 60.0, None if i == 1 else i) for i in range(1, 5)],
                                 "id long, exam_result_id long, school_id long, takers int, passers int, "
                                 "pass_rate double, rank int")
    t = Tables(programs=programs, regions=regions, schools=schools, exam_results=results, school_performance=perf)
    assert [r.school_id for r in rankings.rankings(t, region="north", limit=1).collect()] == []
    assert [r.school_id for r in rankings.rankings(t, region="north", limit=2).collect()] == [3]
    assert [r.rank for r in rankings.rankings(t).orderBy("position").collect()] == [2, 3, 4, None]
    fallback = rankings.program_leaderboard(Tables(**{**t.__dict__, "school_performance": perf.withColumn(
        "pass_rate", F.lit(None).cast("double"))}), min_takers=1)
    assert {r.cycle_label for r in fallback.collect()} == {"May 2019"}


def test_append_log(spark):
    cur = spark.createDataFrame([(4, "old")], "id long, action string")
    new = spark.createDataFrame([("b", 2), ("a", 1)], "action string, arrival long")
    assert sorted((r.id, r.action) for r in ingest.append_log(cur, new).collect()) == [(4, "old"), (5, "a"), (6, "b")]
