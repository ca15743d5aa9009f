"""Interaction of five document filters: what each order of applying them removes, and where.

Every document is one row of a mask matrix (0 where a filter fails it, infinite elsewhere), every order of the filters
one row of a position matrix (the inverse permutation: the step of each filter). Their min-plus product is the step at
which an order removes a document. Documents with the same mask behave alike, so the tables are first counted by
(part, mask), and the product is taken once over the 32 masks and 120 orders; per part, the steps scatter the counts.
"""

from __future__ import annotations

import sys
from itertools import permutations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardstat.frames import materialize

from .shared import as_bytes, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Shares in hundredths: the least of distinct words, the most of capital letters.
DISTINCT, CAPITALS = 65, 5
MARKS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
_MEASURED = "doc_id long, part string, digest binary, mask int"
_COUNTS = ("n", "good", "toxic")
_AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def failures(text: bytes) -> int:
    """The filters A to D that fail a whole text, as bits from A = 1."""
    words = text.split()
    points = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, _UPPER))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1
            | (100 * capitals > CAPITALS * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3)


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             part_column: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask) per row: the failures A to D and the SHA-256 of the whole text; null is empty."""

    def measure(batches):
        import hashlib

        for batch in small_batches(batches):
            texts = as_bytes(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                 pa.array([failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "mask"])

    part = F.coalesce(F.col(part_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long"), part, text_column).mapInArrow(measure, _MEASURED)


def masked(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           part_column: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that fail them, E included.

    E fails a document if its text stands under a smaller id too. Only the holders of a text's smallest id pass, so
    they are found by an equality join on (text, id), over which even a text that most rows share is spread. Rows
    without an id are never failed by E. Repeated rows are documents each; an id with several labels has each of them.
    """
    rows = materialize(measured(docs, id_column, text_column, part_column)
                       .groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "measured")
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    known = rows.where("doc_id is not null")
    known = (known.join(firsts.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
             .withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16))
             .join(marked, "doc_id", "left").select("part", "mask", "n", "good", "toxic"))
    unknown = rows.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    weight = [F.sum("n").alias("n")] + [F.sum(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in _COUNTS[1:]]
    return known.union(unknown).groupBy("part", "mask").agg(*weight)


def removal_steps():
    """The orders as texts, their position matrix (order by filter) and the min-plus product with all 32 masks:
    the step at which each order removes each mask, 6 where nothing does."""
    import numpy as np

    orders = ["".join(p) for p in permutations(FILTERS)]
    places = np.array([[o.index(f) + 1 for f in FILTERS] for o in orders])
    beyond = len(FILTERS) + 1
    masks = np.where(np.arange(32)[:, None] >> np.arange(5) & 1, 0, beyond)
    steps = np.minimum(np.min(masks[:, None, :] + places[None, :, :], axis=2), beyond)
    return orders, places, steps


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    Columns: part, filter_order, step, and of the documents of the part: kept (left after the step), removed (by it),
    redundant (its filter fails them, an earlier one removed them), unique_fails (no other filter fails them),
    good_lost and toxic_lost (of those removed), shapley (removed by the filter over all orders). A null part or text
    is empty; an empty table gives no row; other columns are not read.
    """
    counts = masked(docs, labels, id_column, text_column, part_column)
    # at most 32 masks per part meet here
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("masks"))

    def scatter(batches):
        import numpy as np

        orders, places, steps = removal_steps()
        fails = np.arange(32)[:, None] >> np.arange(5) & 1
        filter_at = np.argsort(places, axis=1)
        order_of = np.broadcast_to(np.arange(len(orders)), steps.shape)
        # the step of an order at which a failing filter stands, for redundancies: mask by order by step
        late = fails[:, filter_at] * (steps[:, :, None] < np.arange(1, 6))

        def by_step(weights):
            hits = np.zeros((len(orders), 7), np.int64)
            np.add.at(hits, (order_of, steps), weights[:, None])
            return hits[:, 1:6]

        for batch in batches:
            for row in batch.to_pylist():
                n, good, toxic = (np.zeros(32, np.int64) for _ in _COUNTS)
                for m in row["masks"]:
                    n[m["mask"]], good[m["mask"]], toxic[m["mask"]] = (m[c] for c in _COUNTS)
                removed = by_step(n)
                per_filter = np.zeros(5, np.int64)
                np.add.at(per_filter, filter_at, removed)
                only = n[1 << np.arange(5)]
                columns = [n.sum() - removed.cumsum(axis=1), removed, np.tensordot(n, late, 1), only[filter_at],
                           by_step(good), by_step(toxic), per_filter[filter_at]]
                size = removed.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * size), pa.array(np.repeat(orders, 5).tolist()),
                     pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(orders))),
                     *[pa.array(c.reshape(-1).astype(np.int64)) for c in columns]],
                    [c.split()[0] for c in _AUDIT.split(", ")])

    return parts.mapInArrow(scatter, _AUDIT)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b,
        (100 * (length(t.x) - length(regexp_replace(t.x, '[A-Z]', '', 'g'))) > 5 * length(t.x))::INT AS c,
        regexp_matches(t.x, '[#$%&*|]')::INT AS d, coalesce(firsts.first < t.doc_id, false)::INT AS e
      FROM t JOIN firsts ON t.x = firsts.x LEFT JOIN marks ON t.doc_id = marks.doc_id),
m AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p, l q, l r, l s, l u
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
hits AS (SELECT m.*, filter_order,
           least(CASE WHEN a = 1 THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b = 1 THEN strpos(filter_order, 'B') ELSE 6 END,
                 CASE WHEN c = 1 THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d = 1 THEN strpos(filter_order, 'D') ELSE 6 END,
                 CASE WHEN e = 1 THEN strpos(filter_order, 'E') ELSE 6 END) AS gone FROM m, orders),
counted AS (
  SELECT part, h.filter_order, step, substr(h.filter_order, step, 1) AS letter,
         sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone < step AND CASE substr(h.filter_order, step, 1)
               WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN a + b + c + d + e = 1 AND CASE substr(h.filter_order, step, 1)
               WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM hits h JOIN steps ON h.filter_order = steps.filter_order GROUP BY part, h.filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted"""
