"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the words of a document at the places of a fixed mask; the places between are ignored. The mask
fits into every window of 13 words with at most two substituted ones, clear of both, so an equality join of the
documents' and the benchmark's seeds misses no such window. Around each hit the words are compared on the hit's
diagonal, and windows with at least 11 of 13 equal words are overlaps. Items shorter than the mask are hashed whole and
joined with the documents' runs of as many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardstat.frames import materialize

MASK = (0, 1, 3, 6, 7)
SPAN = MASK[-1] + 1
WINDOW = 13
SUBSTITUTIONS = 2
#: Seeds of a benchmark that may be broadcast: 16 bytes each. Larger benchmarks are joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Hits that may be broadcast to find their documents' texts again; more are joined by shuffle.
BROADCAST_HITS = 200_000
#: The fewest words of an item that may differ in one place: the mask fits clear of any one word of ten.
ONE_OFF = 10
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; the first or last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK)


def seeds(hashes: str) -> Column:
    """Seeds of all positions of an array column of word hashes, by position."""
    of = ", ".join(f"{hashes}[i + {p}]" for p in MASK)
    return F.expr(f"IF(size({hashes}) < {SPAN}, array(), "
                  f"transform(sequence(0, size({hashes}) - {SPAN}), i -> xxhash64({of})))")


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    return (rows.select(key, hashes.alias("hashes"))
            .select(key, F.posexplode(seeds("hashes")).alias(f"{key}_at", "seed")))


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS,
             broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, item_words, doc_start, doc_end (word
    positions, the end excluded), best_match (most equal words in a window).

    Windows have 13 aligned words, 11 of them equal; a shorter item must occur as a whole, one of 10 to 12 words with one
    word at most replaced. Null texts have no words, and an item without words is found nowhere; rows without an id are
    not compared; repeated rows give one result.
    """
    items = (benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("words"))
             .select("item_id", F.filter("words", lambda w: w != "").alias("words")).distinct())
    every = materialize(items.where(F.size("words") > 0), "items")
    items = every.where(F.size("words") >= SPAN)
    tests = materialize(_hashed(items, "item_id"), "seeds")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    if tests.count() <= broadcast_seeds:
        tests = F.broadcast(tests)
    hits = (_hashed(texts.select("doc_id", words(F.col("text")).alias("words")), "doc_id").join(tests, "seed")
            .select("doc_id", "item_id", (F.col("doc_id_at") - F.col("item_id_at")).alias("diagonal")).distinct())
    hits = materialize(hits, "hits")
    if hits.count() <= broadcast_hits:
        hits = F.broadcast(hits)
    raw = words(F.col("text"))
    diagonal = F.col("diagonal") - F.when(raw[0] == "", 1).otherwise(0)
    near = texts.join(hits, "doc_id").join(items.withColumnRenamed("words", "test"), "item_id").select(
        "doc_id", "item_id", F.xxhash64("text").alias("version"), diagonal.alias("diagonal"), "test",
        F.filter(raw, lambda w: w != "").alias("words"))
    # only the part of a text that lies beside the item goes on
    skipped, start = F.greatest(-F.col("diagonal"), F.lit(0)), F.greatest("diagonal", F.lit(0))
    beside = F.slice("words", start + 1, F.size("test") - skipped)
    pairs = near.select(
        "doc_id", "item_id", "version", "diagonal", F.size("test").alias("n"), start.alias("start"),
        F.posexplode(F.arrays_zip(F.slice("test", skipped + 1, F.size("test")).alias("t"), beside.alias("d"))))
    pairs = pairs.where("col.t is not null and col.d is not null").select(
        "doc_id", "item_id", "version", "diagonal", "n", (F.col("start") + F.col("pos")).alias("place"),
        (F.col("col.t") == F.col("col.d")).cast("int").alias("equal")).distinct()
    ahead = Window.partitionBy("doc_id", "item_id", "version", "diagonal").orderBy("place").rowsBetween(0, WINDOW - 1)
    size = F.least(F.lit(WINDOW), F.col("n"))
    windows = pairs.select("doc_id", "item_id", "n", "place", F.sum("equal").over(ahead).cast("int").alias("match"),
                           F.count("*").over(ahead).alias("seen"))
    least = size - F.when(F.col("n") < ONE_OFF, 0).when(F.col("n") < WINDOW, 1).otherwise(SUBSTITUTIONS)
    found = (windows.where((F.col("seen") == size) & (F.col("match") >= least)).groupBy("doc_id", "item_id")
            .agg(F.max("n").alias("item_words"), F.min("place").alias("doc_start"),
                 F.max(F.col("place") + size).alias("doc_end"), F.max("match").alias("best_match")))
    return found.union(_short_overlaps(texts, every.where(F.size("words") < SPAN), broadcast_seeds))


def _short_overlaps(texts: DataFrame, items: DataFrame, broadcast_seeds: int) -> DataFrame:
    """Overlaps with items of fewer words than the mask spans, word for word."""
    keyed = materialize(items.select("item_id", F.col("words").alias("test"), F.size("words").alias("n"),
                                     F.xxhash64("words").alias("seed")), "short-items")
    lengths = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # fewer than SPAN

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))
        made = F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.xxhash64(F.slice("words", i + 1, n)).alias("seed")))
        return F.when(F.size("words") >= n, made).otherwise(F.array().cast("array<struct<n:int,at:int,seed:bigint>>"))

    if keyed.count() <= broadcast_seeds:
        keyed = F.broadcast(keyed)
    known = texts.select("doc_id", F.filter(words(F.col("text")), lambda w: w != "").alias("words"))
    known = known.where(F.lit(bool(lengths)))
    found = known.select("doc_id", "words", F.explode(F.flatten(F.array(*map(runs, lengths or [1])))).alias("run")).select("doc_id", "words", "run.*").join(keyed, ["n", "seed"])
    return found.where(F.slice("words", F.col("at") + 1, F.col("n")) == F.col("test")).groupBy("doc_id", "item_id").agg(
        F.max("n").alias("item_words"), F.min("at").alias("doc_start"), F.max(F.col("at") + F.col("n")).alias("doc_end"),
        F.max("n").alias("best_match"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, without those that overlap a benchmark item."""
    found = materialize(overlaps(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') w
           FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') w
      FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, w, len(w) n, least(13, len(w)) size FROM b WHERE len(w) >= 1),
dw AS (SELECT doc_id, len(w) dn, unnest(w) word, generate_subscripts(w, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, n, size, unnest(w) word, generate_subscripts(w, 1) - 1 AS q FROM items),
equal AS (SELECT DISTINCT doc_id, dn, item_id, n, size, p - q AS diagonal, q FROM dw JOIN iw USING (word)),
counted AS (SELECT doc_id, dn, item_id, n, size, diagonal, q,
                   count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) m
            FROM equal),
-- a best window may start before an equal word: every start up to two places before one is tried
starts AS (SELECT DISTINCT doc_id, dn, item_id, n, size, diagonal, q - k AS s
           FROM counted, (SELECT unnest([0, 1, 2]) k) WHERE m >= least(13, n) - 2),
windows AS (SELECT s.doc_id, s.item_id, s.n, s.size, s.diagonal, s.s, count(*) m
            FROM starts s JOIN equal e ON e.doc_id = s.doc_id AND e.item_id = s.item_id AND e.diagonal = s.diagonal
                 AND e.dn = s.dn AND e.q >= s.s AND e.q < s.s + s.size
            WHERE s.s >= 0 AND s.s + s.size <= s.n AND s.s + s.diagonal >= 0 AND s.s + s.diagonal + s.size <= s.dn
            GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(n) AS int) item_words, CAST(min(s + diagonal) AS int) doc_start,
       CAST(max(s + diagonal + size) AS int) doc_end, CAST(max(m) AS int) best_match
FROM windows WHERE m >= size - CASE WHEN n < 10 THEN 0 WHEN n < 13 THEN 1 ELSE 2 END GROUP BY doc_id, item_id"""
