"""Helpers of the corpus operators: text slices inside tasks, literal tables, connected components of link tables."""

from __future__ import annotations

import gc
import re
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardstat.frames import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker; functions shipped by value have no module of their own."""
    name = "corpus_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches; what Arrow has freed meanwhile goes back to the system after each."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller pieces, so a step holds the texts and results of few rows at a time.

    The cyclic garbage collector rests meanwhile: the steps make millions of small objects and no cycles.
    """
    gc.disable()
    try:
        for batch in lean(batches):
            for start in range(0, len(batch), rows):
                yield batch.slice(start, rows)
    finally:
        gc.enable()


def slices(data: bytes, size: int) -> Iterator[bytes]:
    """Consecutive parts of about `size` bytes, cut only at ASCII white space, so no word is torn."""
    start = 0
    while len(data) - start > size:
        cut = _SPACE.search(data, start + size)
        if not cut:
            break
        yield data[start:cut.start()]
        start = cut.end()
    yield data[start:] if start else data


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).fill_null(b"").to_numpy(zero_copy_only=False).tolist()


def frame(spark: SparkSession, schema: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """Rows known to the driver, of bounded number, as a frame that needs no Python on the executors."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(schema.items(), columns)}))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected link table (a, b): one row (node, root) per node of a link, root the
    smallest node of its component.

    Alternates two star steps: all larger neighbours of a node are linked to its smallest neighbour, then all smaller
    ones are. Each step is a map-side-combined minimum and a join with it; every step's result is a table in the
    shared folder, so a lost executor costs its own tasks only and the plan does not grow. The number of rounds grows
    with the logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        larger = materialize(larger, "links")
        # every node has few smaller neighbours now, so this minimum needs no table of its own
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        rest = larger.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(rest.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return materialize(links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "components")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)
