"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in at most four bits, one segment
differs in at most one bit, so the two share the signature of that segment with that bit blanked. Each distinct
fingerprint is indexed under its 64 one-blank signatures; an equality join by signature finds all candidates, each of
which is verified on the whole fingerprints.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardstat.frames import materialize

from .shared import as_bytes, components, slices, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: (first bit, number of bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one signature that are compared in one piece; larger groups are compared chunk against chunk.
CHUNK = 4096
PART = 1 << 20


def _fingerprint(text: bytes) -> int:
    import numpy as np
    import xxhash

    hashed, votes, total, last = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []

    def add(values: list[int]) -> None:
        nonlocal votes, total
        total += len(values)
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if len(bits) > 255:
            bits = np.concatenate([bits, np.zeros((-len(bits) % 255, 64), np.uint8)])
            votes += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        else:
            votes += bits.sum(axis=0, dtype=np.int64)

    for part in slices(text.lower(), PART):
        words = last + part.split()
        if len(words) >= SHINGLE:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
            line = b" ".join(words)
            add([hashed(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())])
            last = words[1 - SHINGLE:]
        else:
            last = words
    if not total and last:
        add([hashed(b" ".join(last), SEED)])
    bits = (2 * votes > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) per row: the SimHash of the whole text as a signed 64-bit number.

    A-Z is lowered; words are runs of bytes other than ASCII white space; features are the hashes of all four-word
    shingles, repeats included, or of the whole sequence if it is shorter. A null, empty or blank text has 0.
    """
    kind = dict(docs.dtypes)[id_column]

    def hashes(batches):
        import numpy as np

        for batch in small_batches(batches):
            found = np.array([_fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_column, "fp"])

    return docs.select(id_column, text_column).mapInArrow(hashes, f"`{id_column}` {kind}, fp long")


def signature(fp: Column, blank: Column) -> Column:
    """The signature of a fingerprint with bit `blank` left out: that bit's place and the rest of its segment."""
    shift, size = F.lit(SEGMENTS[0][0]), F.lit(SEGMENTS[0][1])
    for first, bits in SEGMENTS[1:]:
        shift = F.when(blank >= first, F.lit(first)).otherwise(shift)
        size = F.when(blank >= first, F.lit(bits)).otherwise(size)
    inside = F.call_function("shiftrightunsigned", fp, shift).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1)
    kept = inside.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), blank - shift)))
    return F.call_function("shiftleft", blank.cast("long"), F.lit(24)).bitwiseOR(kept)


def variants(distinct: DataFrame) -> DataFrame:
    """(signature, fp): 64 rows per fingerprint."""
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("blank"))
    return rows.select(signature(F.col("fp"), F.col("blank")).alias("signature"), "fp")


def _near(a, b):
    import numpy as np

    return np.bitwise_count(a ^ b) <= MAX_DISTANCE


def _spanning(points) -> Iterator[tuple]:
    """Links that connect all points of one group that are connected by links: each point is compared once with those
    that no earlier point has reached, so a dense group takes a few passes and gives fewer links than it has points."""
    import numpy as np

    rest, queue = points, []
    while len(rest) or queue:
        if not queue:
            if len(rest) < 2:
                return
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        hit = _near(rest, at)
        if hit.any():
            found = rest[hit]
            yield np.full(len(found), at), found
            queue.extend(found)
            rest = rest[~hit]


def _links(keys, points) -> Iterator[tuple]:
    """Links inside the groups of a run of rows sorted by key: small groups together, at one distance of rows after the
    other; large ones by `_spanning`."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= 16, sizes)
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16]):
        yield from _spanning(points[start:start + size])
    group = np.repeat(np.arange(len(starts)), sizes)
    at, step = np.flatnonzero(small), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            return
        hit = at[_near(points[at], points[at + step])]
        if len(hit):
            yield points[hit], points[hit + step]
        step += 1


_FOUND = "signature long, chunk int, a long, b long"


def _compare(batches, chunk: int):
    """Rows sorted by signature to links (a, b); a group too large to hold leaves its points, numbered by chunks."""
    import numpy as np

    keys, points = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    over: dict = {}

    def batch(signature, number, a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, signature), pa.int64()) if signature is not None else pa.nulls(n, pa.int64()),
             pa.array(np.full(n, number), pa.int32()) if number is not None else pa.nulls(n, pa.int32()),
             pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else pa.nulls(n, pa.int64())],
            ["signature", "chunk", "a", "b"])

    def spill(key, held):
        number = over.get(key, 0)
        over.clear()
        over[key] = number + 1
        return batch(key, number, held, None)

    def flush(keys, points):
        if len(keys) and keys[0] in over:
            n = np.searchsorted(keys, keys[0], "right")
            yield spill(keys[0], points[:n])
            keys, points = keys[n:], points[n:]
        if len(keys):
            pairs = list(_links(keys, points))
            if pairs:
                yield batch(None, None, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))

    for rows in batches:
        keys = np.r_[keys, rows.column(0).to_numpy(zero_copy_only=False)]
        points = np.r_[points, rows.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(keys):
            continue
        cut = np.searchsorted(keys, keys[-1], "left")
        yield from flush(keys[:cut], points[:cut])
        keys, points = keys[cut:], points[cut:]
        while len(keys) >= chunk:
            yield spill(keys[0], points[:chunk])
            keys, points = keys[chunk:], points[chunk:]
    yield from flush(keys, points)


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b) over distinct fingerprints: links of at most four differing bits that connect all that such links connect.

    A signature shared by more than about `chunk` fingerprints is compared chunk against chunk, each pair of chunks in
    a task of its own, so no task holds more than two chunks of it.
    """
    rows = variants(distinct).repartition("signature").sortWithinPartitions("signature")
    found = materialize(rows.mapInArrow(lambda b: _compare(b, chunk), _FOUND), "near")
    pairs = found.where("signature is null").select("a", "b")
    points = found.where("signature is not null").select("signature", "chunk", F.col("a").alias("fp"))
    last = points.groupBy("signature").agg(F.max("chunk").alias("last"))
    both = (points.join(last, "signature")
            .select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
            .select("signature", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp"))

    def across(table: pa.Table) -> pa.Table:
        import numpy as np

        held = list(_spanning(table.column("fp").to_numpy().view(np.uint64)))
        ends = [np.concatenate([h[k] for h in held]).view(np.int64) if held else np.zeros(0, np.int64) for k in (0, 1)]
        return pa.table({"a": ends[0], "b": ends[1]})

    return pairs.union(both.groupBy("signature", "i", "j").applyInArrow(across, "a long, b long"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id: the smallest id reachable over links.

    Equal fingerprints are one point, so copies cost nothing but their own rows. Rows without an id link like others;
    a component whose rows all lack one has the component_id null. Repeated rows are returned each.
    """
    prints = materialize(fingerprints(docs, id_column, text_column).withColumnRenamed(id_column, "id"), "fingerprints")
    points = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = components(links(points, chunk))
    points = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = points.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(points.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with one left of each group: the smallest id. Rows without an id are kept as they are; rows that repeat
    an id are one document, of which the first by all other columns stays."""
    found = near_duplicates(docs.where(F.col(id_column).isNotNull()), id_column, text_column)
    kept = materialize(found.where(F.col(id_column) == F.col("component_id")).groupBy(id_column)
                       .agg(F.count("*").alias("_rows")), "kept")
    # texts are shuffled at every size: what stays is a constant part of the input and never surely small
    once = docs.join(kept.where("_rows = 1").select(id_column).hint("merge"), id_column, "left_semi")
    again = (docs.join(kept.where("_rows > 1").select(id_column), id_column, "left_semi")
             .groupBy(id_column).agg(F.min(F.struct(*[c for c in docs.columns if c != id_column])).alias("_row"))
             .select(id_column, "_row.*"))
    return (once.unionByName(again.select(docs.columns)).select(docs.columns)
            .unionByName(docs.where(F.col(id_column).isNull())))
