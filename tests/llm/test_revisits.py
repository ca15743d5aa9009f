import random

from pyspark.sql import functions as F

from boardstat.llm import revisits

SCHEMA = "record_id long, url string, at long, kind string, digest string, headers map<string,string>, target string, state int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)


def resolved(spark, rows):
    return {r["record_id"]: r for r in revisits.resolve(frame(spark, rows)).collect()}


def test_canonical_url(spark):
    cases = {"http://www.A.example.com:80/en/5/?utm_source=x&b=2&a=1#top": "a.example.com/en/5?a=1&b=2",
             "https://m.a.example.com/en/5.html": "a.example.com/en/5", "http://a.example.com/x?ref=y": "a.example.com/x",
             "a.example.com": "a.example.com", "": "", None: None, "http://a.example.com/P?Q=R": "a.example.com/P?Q=R"}
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in rows.collect()} == cases


def test_states_and_merged_headers(spark):
    url, tagged = "http://a.example.com/1", {"etag": '"x"', "content-type": "text/html", "cache-control": "no-store", "age": "1"}
    got = resolved(spark, [
        (1, url, 10, "response", "d1", tagged),
        (2, url + "#f", 11, "revisit", "d1", {"etag": 'W/"x"', "cache-control": "max-age=9", "content-type": "no", "date": "z"}),
        (3, url, 12, "revisit", None, {"etag": '"y"'}),
        (4, url, 13, "revisit", "d2", {"etag": '"x"'}),
        (5, url, 14, "revisit", None, {"last-modified": "m"}),
        (6, url, 9, "revisit", "d1", {}),
        (7, url, 15, "revisit", "d1", None),
        (8, None, 20, "revisit", "d1", {"etag": '"x"'}),
        (9, url, None, "revisit", "d1", {"etag": '"x"'}),
        (10, url, 30, "response", "d3", {"etag": '"z"'}),
        (11, url, 30, "revisit", "d3", {"etag": '"z"'}),
        (0, url, 30, "revisit", "d1", {"etag": '"x"'})])
    states = {i: (r["state"], r["target_id"]) for i, r in got.items()}
    assert states == {2: ("resolved", 1), 3: ("changed", 1), 4: ("changed", 1), 5: ("unproven", 1), 6: ("missing", None),
                      7: ("resolved", 1), 8: ("missing", None), 9: ("missing", None), 11: ("resolved", 10), 0: ("resolved", 1)}
    assert got[2]["headers"] == {"etag": '"x"', "content-type": "text/html", "age": "1", "cache-control": "max-age=9", "date": "z"}
    assert got[2]["digest"] == "d1" and got[3]["headers"] == {"etag": '"y"'} and got[8]["headers"] == {"etag": '"x"'}


def test_as_of_join_with_a_hot_url(spark):
    draw = random.Random(2)
    rows = []
    for i in range(3000):
        url = "http://hot.example.com/" if draw.random() < 0.7 else f"http://x.example.com/{draw.randrange(40)}"
        rows.append((i, url, draw.randrange(500), "response" if draw.random() < 0.2 else "revisit", f"d{draw.randrange(2)}", {}))
    rows += rows[-5:]
    full = sorted((r[1], r[2], r[0]) for r in rows if r[3] == "response")
    expected = sorted((r[0], str(max((t[2:] for t in [(u, (a, i), i) for u, a, i in full if u == r[1] and (a, i) < (r[2], r[0])]), default=None,
                                     key=lambda x: x) and max((a, i) for u, a, i in full if u == r[1] and (a, i) < (r[2], r[0]))[1]))
                      for r in rows if r[3] == "revisit")
    got = sorted((r["record_id"], str(r["target_id"])) for r in revisits.resolve(frame(spark, rows)).collect())
    assert got == expected


def test_empty_table(spark):
    assert revisits.resolve(frame(spark, [])).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert revisits.captures(pages).collect() == []
    odd = spark.createDataFrame([(1, None, None), (None, "http://a.example.com/", "x")], "page_id long, url string, html string")
    assert {r["state"] for r in revisits.resolve(revisits.captures(odd)).collect()} == {"missing"}
