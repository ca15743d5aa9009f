"""A stored gram dictionary: containment searches over text columns that never cut a text again.

Every place of a text begins a gram of three characters; the end is padded, so the last places do too. The grams are
written once, partitioned by entity and by a hash of the gram, beside a prefix table that names, for a prefix of one to
three characters, the grams that begin with it and the number of their places. Whoever contains a text contains its
pieces: a set of words is looked up by its rarest piece, a gram of a longer word or a short word as a prefix, and the
texts found are tested as wholes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import fresh_path, materialize

GRAM = 3
#: Partitions of the grams of one entity; also the most values that a lookup collects per entity.
PARTS = 32
_PAD = "\0" * (GRAM - 1)
_POSTINGS = "gram string, text_id long, entity string, part int"


@dataclass(frozen=True)
class TextIndex:
    """Stored tables: texts (entity, text_id, text), prefixes (entity, prefix, places, grams), and under `folder` the
    postings (gram, text_id) partitioned by entity and part."""

    texts: DataFrame
    prefixes: DataFrame
    folder: str

    def postings(self) -> DataFrame:
        return self.texts.sparkSession.read.schema(_POSTINGS).parquet(self.folder)


def _pieces(text: Column, places: Column) -> Column:
    """Distinct grams that begin at the first `places` places."""
    return F.when(places >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(places, F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(
        F.array().cast("array<string>"))


def build_index(texts: DataFrame) -> TextIndex:
    """Index of (entity, text) rows; equal rows count once, null texts are left out, an empty text is found by nothing."""
    spark = texts.sparkSession
    known = materialize(texts.select("entity", "text").where("text is not null").distinct()
                        .withColumn("text_id", F.monotonically_increasing_id()), "texts")
    cut = known.select("entity", "text_id", F.explode(_pieces(F.concat("text", F.lit(_PAD)), F.length("text"))).alias("gram"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int")).select("gram", "text_id", "entity", "part")
    folder = fresh_path(spark, "grams")
    # ranges over all columns: a gram that most texts have spans many tasks and files
    cut.repartitionByRange("entity", "part", "gram", "text_id").write.partitionBy("entity", "part").parquet(folder)
    stored = spark.read.schema(_POSTINGS).parquet(folder)
    grams = stored.groupBy("entity", "part", "gram").agg(F.count("*").alias("places"))
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substr("gram", F.lit(1), n))
    named = grams.select("entity", "places", F.struct("part", "gram").alias("key"), F.explode(prefixes).alias("prefix"))
    named = named.groupBy("entity", "prefix").agg(F.sum("places").alias("places"), F.collect_list("key").alias("grams"))
    return TextIndex(known, materialize(named, "prefixes"), folder)


def _partition_filter(keys: DataFrame) -> Column:
    """The partitions that hold the wanted grams, at most PARTS per entity."""
    wanted: dict[str, list[int]] = {}
    for row in keys.select("entity", "part").distinct().collect():
        wanted.setdefault(row["entity"], []).append(row["part"])
    condition = F.lit(False)
    for entity, parts in sorted(wanted.items()):
        condition = condition | ((F.col("entity") == entity) & F.col("part").isin(sorted(parts)))
    return condition


def containing_all(sets: DataFrame, index: TextIndex) -> DataFrame:
    """All (entity, tokens, text) whose text holds every token of a set of lower-cased words (entity, tokens)."""
    sets = sets.select("entity", "tokens").distinct()
    words = sets.select("entity", "tokens", F.explode("tokens").alias("token")).where("token <> ''")
    pieces = F.when(F.length("token") < GRAM, F.array("token")).otherwise(
        _pieces(F.col("token"), F.length("token") - (GRAM - 1)))
    asked = words.select("entity", "tokens", F.explode(pieces).alias("prefix"))
    rarest = asked.join(index.prefixes, ["entity", "prefix"]).groupBy("entity", "tokens").agg(
        F.min_by("grams", F.struct("places", "prefix")).alias("grams"))
    keys = materialize(rarest.select("entity", "tokens", F.explode("grams").alias("key"))
                       .select("entity", "tokens", "key.*"), "keys")
    found = (index.postings().where(_partition_filter(keys)).join(keys, ["entity", "part", "gram"])
             .select("entity", "tokens", "text_id").distinct())
    return (found.join(index.texts, ["entity", "text_id"])
            .where(F.forall("tokens", lambda t: F.contains(F.col("text"), t))).select("entity", "tokens", "text"))


def one_entity(texts: DataFrame, entity: str = "text") -> DataFrame:
    return texts.select(F.lit(entity).alias("entity"), "text")


def stored_bytes(spark: SparkSession, index: TextIndex) -> int:
    """Size of the postings on disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(index.folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
