"""Vector code compression: four integer codebooks of up to 256 entries, refined in four rounds.

Components become integers. Inside a task, each dimension of a block of vectors gets a dictionary of its distinct
integers; the squared differences of every dictionary value to all entries are tabulated once, and the distance of a
part to an entry is a sum of gathered table rows, one per dimension. Codebooks are of a fixed size, so they travel in
the function; sums and counts come back pre-aggregated per task. All arithmetic is on integers, so results do not
depend on the order of rows.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardstat.frames import materialize

from .shared import lean

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances are held at once: a block by ENTRIES table of numbers.
BLOCK = 1024
#: Integers up to this size keep every sum of squared differences of 2^20 dimensions inside 64 bits.
LARGEST = 1 << 20
#: Most labels whose sums are sent to every task (about 16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 100_000


def integers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
             label_column: str = "label") -> DataFrame:
    """(id, label, ints) of the rows whose vector is whole: not null, no null or non-finite component."""
    value = F.col(vector_column)
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(value, lambda x: F.floor(x.cast("double") * SCALE))
    return vectors.where(value.isNotNull() & whole).select(
        F.col(id_column).alias("id"), F.col(label_column).alias("label"), ints.alias("ints"))


def _matrix(column: pa.Array, width: int):
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def nearest(block, book):
    """(entry, squared distance) of each row of `block` in one codebook; ties go to the lower index."""
    import numpy as np

    total = np.zeros((len(block), len(book)), np.int64)
    for d in range(block.shape[1]):
        values, codes = np.unique(block[:, d], return_inverse=True)
        table = (values[:, None] - book[None, :, d]) ** 2
        total += table[codes]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(block)), best]


def _blocks(batches, width: int):
    for batch in lean(batches):
        for start in range(0, len(batch), BLOCK):
            piece = batch.slice(start, BLOCK)
            yield piece, _matrix(piece.column(piece.schema.get_field_index("ints")), width)


def _refined(table: DataFrame, books, width: int):
    """Every entry replaced by the floored mean of its parts; entries without parts stay."""
    import numpy as np

    size = width // PARTS

    def sums(batches):
        total = np.zeros((PARTS, len(books[0]), size), np.int64)
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        for _, block in _blocks(batches, width):
            for p, book in enumerate(books):
                piece = block[:, p * size:(p + 1) * size]
                best, _ = nearest(piece, book)
                np.add.at(total[p], best, piece)
                counts[p] += np.bincount(best, minlength=len(book))
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)),
             pa.array([int(counts[p, e]) for p, e in used], pa.int64()),
             pa.array([total[p, e].tolist() for p, e in used], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = table.select("ints").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    # wider than 64 bits: sums over all rows of a large table
    wide = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
    new = [book.copy() for book in books]
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # PARTS * ENTRIES rows
        new[row["part"]][row["entry"]] = [int(row[f"s{j}"]) // row["n"] for j in range(size)]
    return new


def codebooks_digest(books) -> str:
    """SHA-256 over all integers by part, entry and position, joined by commas."""
    text = ",".join(str(int(x)) for book in books for entry in book for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def fit(table: DataFrame, width: int):
    """Codebooks over (id, ints) rows of one width: the parts of the smallest ids, refined in ROUNDS rounds over all."""
    import numpy as np

    size = width // PARTS
    first = table.select("id", "ints").orderBy("id", "ints").limit(ENTRIES).collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), width)
    books = [start[:, p * size:(p + 1) * size].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        books = _refined(table, books, width)
    return books


def encode(table: DataFrame, books, width: int) -> DataFrame:
    """(id, label, code, error) per row: two hex digits per part, and the squared distance summed over the parts."""
    import numpy as np

    size = width // PARTS
    id_type, label_type = (dict(table.dtypes)[c] for c in ("id", "label"))

    def codes(batches):
        digits = np.array([f"{i:02x}" for i in range(ENTRIES)])
        for piece, block in _blocks(batches, width):
            code, error = np.full(len(block), "", "U8"), np.zeros(len(block), np.int64)
            for p, book in enumerate(books):
                best, distance = nearest(block[:, p * size:(p + 1) * size], book)
                code, error = np.char.add(code, digits[best]), error + distance
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(code.tolist(), pa.string()), pa.array(error)],
                ["id", "label", "code", "error"])

    return table.select("id", "label", "ints").mapInArrow(
        codes, f"id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
             label_column: str = "label") -> DataFrame:
    """One row per whole vector: id, code, error, label_error (error summed over equal labels, nulls together),
    codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped. The vectors of a table have one length,
    a multiple of four: that of the smallest id. Vectors of another length, or with a component of 1024 or more in
    size (whose squares could leave 64 bits), cannot be compared and give a row with code, error and label_error null.
    Repeated rows and ids count each; fewer than 256 vectors give as many entries. An empty table gives no row.
    Other columns are not read.
    """
    table = materialize(integers(vectors, id_column, vector_column, label_column), "integers")
    first = table.orderBy("id", "ints").select(F.size("ints").alias("width")).first()
    width = first["width"] if first else 0
    fits = ((F.size("ints") == width) & (F.lit(width % PARTS) == 0)
            & F.forall("ints", lambda x: F.abs(x) <= LARGEST))
    good = table.where(fits)
    books = fit(good, width) if first and width % PARTS == 0 else [[] for _ in range(PARTS)]
    done = materialize(encode(good, books, width), "codes")
    sums = materialize(done.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    sums = sums.withColumnRenamed("label", "_label")
    rows = done.join(sums, done["label"].eqNullSafe(sums["_label"])).select("id", "code", "error", "label_error")
    rest = table.where(~fits).select("id", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("code", "string"), ("error", "long"), ("label_error", "long"))])
    return rows.union(rest).select(F.col("id").alias(id_column), "code", "error", "label_error",
                                   F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    assign = """a{r} AS (SELECT id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.id, x.part, entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS d
  FROM x JOIN b{r} b ON x.part = b.part) GROUP BY id, part)"""
    update = """u{r} AS (SELECT part, entry, list(m ORDER BY j) AS v FROM (
  SELECT x.part, entry, j, floor(sum(x.v[j])::DOUBLE / count(*))::BIGINT AS m
  FROM x JOIN a{r} a ON x.id = a.id AND x.part = a.part, (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM x))) AS j)
  GROUP BY x.part, entry, j) GROUP BY part, entry),
b{n} AS (SELECT b.part, b.entry, coalesce(u.v, b.v) AS v FROM b{r} b LEFT JOIN u{r} u ON b.part = u.part AND b.entry = u.entry)"""
    rounds = ",\n".join(assign.format(r=r) + ",\n" + update.format(r=r, n=r + 1) for r in range(ROUNDS))
    return f"""
WITH k AS (SELECT vec_id AS id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM k, (SELECT unnest([0, 1, 2, 3]) AS part)),
s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM k QUALIFY entry < 256),
b0 AS (SELECT part, entry, v FROM x JOIN s ON x.id = s.id),
{rounds},
{assign.format(r=ROUNDS)},
e AS (SELECT a.id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} a GROUP BY a.id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT e.id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM e JOIN k ON e.id = k.id, h"""


ORACLE = _oracle()
