"""Best-fit packing of tokenized documents into sequences of a fixed length.

The plan is made from the histogram of piece lengths, not from the pieces: it has at most `capacity` counts to read
and gives runs of equal slots. Pieces then take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardstat.frames import materialize

from .shared import frame, lean
from .tokens import as_words, encoded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
#: Rows of one length that are ranked together at most, on average; longer runs of a length are dealt into buckets.
BUCKET_ROWS = 4096


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token pieces of documents: their ids and then `end`, cut into pieces of `capacity` ids, the last one shorter.

    Columns: id, piece (from 0), start (ids before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers) and, on demand, ids. A null or empty text is the single id `end`; repeated rows are cut each.
    """
    kind = dict(docs.dtypes)[id_column]
    schema = {id_column: None, "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        schema["ids"] = pa.list_(pa.int32())
    close = as_words([end])

    def cut(batches):
        for batch in lean(batches):
            for start, _, counts, ids in encoded(path, batch.column(1), True):
                rows = {name: [] for name in schema}
                of, ends = [], counts.cumsum()
                for row, (n, stop) in enumerate(zip(counts.tolist(), ends.tolist())):
                    data = ids[stop - n:stop].tobytes() + close
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at:at + 4 * capacity]
                        of.append(start + row)
                        rows["piece"].append(piece)
                        rows["start"].append(at // 4)
                        rows["length"].append(len(part) // 4)
                        rows["ids_crc32"].append(zlib.crc32(part))
                        if with_ids:
                            rows["ids"].append(np.frombuffer(part, "<u4").astype("int32"))
                keys = batch.column(0).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(rows[n], t) for n, t in schema.items() if t is not None)], list(schema))

    columns = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_column, text_column).mapInArrow(cut, columns + ", ids array<int>" * with_ids)


def best_fit(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over a histogram of lengths: rows (length, rank_from, n, sequence_from, offset), each for
    n pieces of ranks rank_from.. that go to n sequences from sequence_from on, all at one offset.

    Sequences with equal room are runs of numbers, so one step places a whole run; the outcome is that of placing the
    pieces one by one.
    """
    plan, room, sizes, sequences = [], {}, [], 0

    def keep(size: int, start: int, n: int) -> None:
        if size:
            if size not in room:
                room[size] = []
                insort(sizes, size)
            room[size].append((start, n))

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            fresh = at == len(sizes)
            if fresh:
                size, start, n = capacity, sequences, left
            else:
                size = sizes[at]
                start, n = room[size].pop()
                if not room[size]:
                    del room[size], sizes[at]
            # the tightest sequence stays the tightest while a piece of this length still fits
            each = min(size // length, left)
            taken = min(n, left // each)
            for slot in range(each):
                plan.append((length, rank, taken, start, capacity - size + slot * length))
                rank += taken
            if fresh:
                sequences += taken
            elif taken < n:
                keep(size, start + taken, n - taken)
            keep(size - each * length, start, taken)
            left -= each * taken
    return plan


def pack(parts: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """All rows and columns of `parts`, which has a `length` from 1 to `capacity`, with sequence_id and offset.

    `order` names columns that make the ranking within a length total; rows equal in all of them are alike and take
    neighbouring ranks in any order. Only the histogram and the plan pass through the driver; both are bounded by
    `capacity`. Columns that are called sequence_id or offset already are replaced. An empty input gives an empty result.
    """
    spark = parts.sparkSession
    kept = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    parts = materialize(parts.select(kept), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = frame(spark, dict.fromkeys(["length", "_rank_from", "_n", "_sequence_from", "_offset"], pa.int64()),
                        best_fit(counts, capacity))
    buckets = -(-sum(counts.values()) // BUCKET_ROWS) or 1
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = parts.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = (sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
             .join(plan, "length")
             .where("_rank_from < _start + _rows and _rank_from + _n > _start")
             .select("length", "_bucket", (F.col("_rank_from") - F.col("_start")).alias("_low"), "_n",
                     "_sequence_from", "_offset"))
    place = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    slot = F.col("_place") - F.col("_low")
    return (parts.withColumn("_place", place.cast("long")).join(cells, ["length", "_bucket"])
            .where((slot >= 0) & (slot < F.col("_n")))
            .select(*kept, (F.col("_sequence_from") + slot).alias("sequence_id"), F.col("_offset").alias("offset")))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as placed pieces; see `pieces` and `pack`."""
    return pack(pieces(docs, path, capacity, with_ids=with_ids), ["doc_id", "piece", "ids_crc32"], capacity)
