import random
from collections import Counter

from pyspark.sql import functions as F

from boardstat.operators import gram_index
from boardstat.plans import bindings as b
from boardstat.plans import catalog

from .conftest import SF

WORDS = ["ab", "state", "university", "of", "cebu", "a", "main", "st", "xy z", "ñu", "中文", "e\0e"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, text string")


def brute(sets, texts):
    return Counter((e, tuple(ws), t) for e, ws in {(e, tuple(ws)) for e, ws in sets} for f, t in set(texts)
                   if e == f and t is not None and any(ws) and all(w in t for w in ws))


def found(spark, sets, texts):
    index = gram_index.build_index(frame(spark, texts))
    asked = spark.createDataFrame(sets, "entity string, tokens array<string>")
    rows = gram_index.containing_all(asked, index).collect()
    return Counter((r.entity, tuple(r.tokens), r.text) for r in rows)


def partition_filters(df):
    """Partition filters of the scans in a plan."""
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return [line.split("PartitionFilters: [")[1].split("PushedFilters")[0] for line in plan.splitlines() if "PartitionFilters: [" in line]


def test_sets_of_words_against_brute_force(spark):
    draw = random.Random(5)
    texts = [(draw.choice("pq"), " ".join(draw.choices(WORDS, k=draw.randrange(0, 7)))) for _ in range(120)] + [("p", None), ("q", "a")]
    sets = [(draw.choice("pqr"), draw.choices([*WORDS, "ate un", "nobody", "y", "v", "文"], k=draw.randrange(1, 4))) for _ in range(80)]
    sets += [("p", []), ("p", [""]), ("q", ["", "st"]), sets[0]]
    assert found(spark, sets, texts) == brute(sets, texts)


def test_empty_tables(spark):
    assert not found(spark, [], [("p", "abc")]) and not found(spark, [("p", ["abc"])], [])


def test_no_query_cuts_a_text_again(spark):
    index = b.search_index(spark, SF)
    asked = spark.createDataFrame([("school", ["university"])], "entity string, tokens array<string>")
    filters = partition_filters(gram_index.containing_all(asked, index))
    assert any("entity" in f and "part" in f for f in filters)
    for name in ("global_search", "school_search_count", "school_topnotchers"):
        query = catalog.QUERIES[name](spark, SF)
        assert any("entity" in f and "part" in f for f in partition_filters(query))
        assert "sequence(1" not in query._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_a_gram_most_texts_have_is_cut_into_ranges(spark):
    texts = spark.range(4000).select(F.lit("p").alias("entity"), F.concat(F.lit("university "), F.col("id").cast("string")).alias("text"))
    index = gram_index.build_index(texts)
    held = index.postings().where("gram = 'uni'").select(F.col("_metadata.file_path").alias("file")).groupBy("file").count().collect()
    assert sum(r["count"] for r in held) == 4000
    asked = spark.createDataFrame([("p", ["university", "77"])], "entity string, tokens array<string>")
    assert gram_index.containing_all(asked, index).count() == sum("77" in str(i) for i in range(4000))
