"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Each tree splits the vectors near the median of a random projection, again and again; a vector close to a split goes to
both sides. The band of a split is as wide as the projected distance of a pair at the threshold, times a margin, whatever
the node holds; a node so dense that the band would hold much of it is not split. The trees are fitted on a bounded
sample and route every vector. Vectors are compared inside the leaves only, in double precision; a pair that shares
leaves of several trees counts in the first leaf it shares.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardstat.frames import materialize

from .shared import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.93
TREES = 8
#: Width of a split's band in standard deviations of the projected difference of a pair at the threshold. A split parts a
#: pair only if its projected difference is wider; more trees find such pairs at less cost than wider bands do.
MARGIN = 0.5
#: A node whose band would hold more of the sample than this is dense: its pairs lie as close as a pair at the threshold,
#: so a split would part too many of them, and it stays one leaf.
DENSE = 0.12
#: Directions tried for a split, of which the one with the emptiest band is taken.
TRIES = 3
#: Vectors of one label that a leaf should hold, and the size of the blocks that leaves beyond two of them are compared in.
LEAF, BLOCK = 96, 1024
#: Bound of the sample that the trees are fitted on, and the fewest sample vectors that a split is fitted on: trees are at
#: most 13 splits deep, so a leaf has more than two blocks from some 16 million distinct vectors of a label on.
SAMPLE = 131_072
SPLIT_ROWS = 16
SEED = 11


@dataclass
class Tree:
    """A complete binary tree: per inner node a direction, and the bounds below which a vector goes left and above
    which it goes right; between the bounds it goes to both sides."""

    directions: object
    low: object
    high: object
    depth: int

    def leaves(self, vectors):
        """(rows, leaves): every leaf of every vector."""
        import numpy as np

        rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for level in range(self.depth):
            at = nodes + (1 << level) - 1
            projected = np.einsum("ij,ij->i", vectors[rows], self.directions[at])
            left, right = projected <= self.high[at], projected >= self.low[at]
            rows = np.r_[rows[left], rows[right]]
            nodes = np.r_[2 * nodes[left], 2 * nodes[right] + 1]
        return rows, nodes


def grow(sample, depth: int, seed: int, threshold: float = THRESHOLD) -> Tree:
    """A tree fitted on a sample of unit vectors. A node too dense to split sends all to its left child, as does what is
    below it, so it is one leaf; a node without a sample sends all both ways."""
    import numpy as np

    draw, inner, size = np.random.default_rng(seed), (1 << depth) - 1, sample.shape[1]
    tree = Tree(np.zeros((inner, size)), np.zeros(inner), np.zeros(inner), depth)
    half = MARGIN * np.sqrt(2 * (1 - threshold) / size) / 2
    held = [sample]
    for level in range(depth):
        below = []
        for place, rows in enumerate(held):
            at = place + (1 << level) - 1
            tree.low[at] = tree.high[at] = np.inf
            if rows is None:
                below += [None, None]
                continue
            if not len(rows):
                tree.low[at] = -np.inf
                below += [rows, rows]
                continue
            best = (DENSE, 0.0, None)
            for direction in draw.normal(size=(TRIES, size)):
                direction /= np.linalg.norm(direction)
                projected = np.sort(rows @ direction)
                cuts = np.quantile(projected, np.linspace(0.4, 0.6, 9))
                inside = np.searchsorted(projected, cuts + half, "right") - np.searchsorted(projected, cuts - half)
                k = int(inside.argmin())
                best = min(best, (inside[k] / len(rows), cuts[k], direction), key=lambda x: x[0])
            _, cut, direction = best
            if direction is None:
                below += [None, None]
                continue
            tree.directions[at], tree.low[at], tree.high[at] = direction, cut - half, cut + half
            projected = rows @ direction
            below += [rows[projected <= cut], rows[projected > cut]]
        held = below
    return tree


def _unit(column: pa.Array):
    """Unit vectors in double precision of a list column without nulls and of one width."""
    import numpy as np

    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable() -> Column:
    """Whether a row can link: it has a label, and a vector of finite components that is not zero."""
    finite = F.expr("forall(embedding, x -> coalesce(abs(x) < double('Infinity'), false))")
    return F.coalesce(F.col("label").isNotNull() & finite & F.expr("exists(embedding, x -> x <> 0)"), F.lit(False))


_LEAF_ROWS = "tree int, label {label}, width int, leaf long, rep long, n long, embedding {vector}, leaves array<long>"


def _routed(classes: DataFrame, forests: dict[int, list[Tree]]) -> DataFrame:
    kinds = dict(classes.dtypes)

    def route(batches):
        import numpy as np

        for batch in batches:
            width = batch.column(4).to_numpy(zero_copy_only=False)
            for size in np.unique(width):
                part = batch.filter(pa.array(width == size))
                units, trees = _unit(part.column(3)), forests[int(size)]
                places = [tree.leaves(units) for tree in trees]
                # leaf numbers of all trees in one list per vector; a tree's number is in the upper half
                rows = np.concatenate([p[0] for p in places])
                codes = np.concatenate([p[1] + (t << 32) for t, p in enumerate(places)])
                order = np.lexsort((codes, rows))
                rows, codes = rows[order], codes[order]
                ends = np.searchsorted(rows, np.arange(len(units) + 1))
                all_leaves = pa.LargeListArray.from_arrays(ends, codes).cast(pa.list_(pa.int64()))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((codes >> 32).astype(np.int32)), part.column(2).take(at), part.column(4).take(at),
                     pa.array(codes), part.column(0).take(at), part.column(1).take(at), part.column(3).take(at),
                     all_leaves.take(at)],
                    ["tree", "label", "width", "leaf", "rep", "n", "embedding", "leaves"])

    schema = _LEAF_ROWS.format(label=kinds["label"], vector=kinds["embedding"])
    return classes.select("rep", "n", "label", "embedding", "width").mapInArrow(route, schema)


def _first_shared(a, b, leaf: int):
    """Whether `leaf` is the first leaf that the lists of both vectors of each pair have; lists end in -1 and -2."""
    import numpy as np

    shared_before = np.zeros(len(a), bool)
    for k in range(a.shape[1]):
        column = a[:, k]
        earlier = (column >= 0) & (column < leaf)
        if not earlier.any():
            break
        shared_before |= earlier & (b == column[:, None]).any(axis=1)
    return ~shared_before


def _padded(lists: pa.Array, fill: int):
    import numpy as np

    sizes = np.diff(lists.offsets.to_numpy())
    table = np.full((len(lists), sizes.max(initial=1)), fill, np.int64)
    table[np.arange(table.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return table


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside one leaf, or across two of its blocks: per vector the number of vectors it links to, and pairs that
    span what is linked. A dense leaf gives no more rows than it has vectors, twice."""
    import numpy as np

    leaf, i, j = (table.column(c)[0].as_py() for c in ("leaf", "i", "j"))
    rep, weight, block = (table.column(c).to_numpy() for c in ("rep", "n", "block"))
    units = _unit(table.column("embedding").combine_chunks())
    lists = table.column("leaves").combine_chunks()
    one, two = _padded(lists, -1), _padded(lists, -2)
    count, joined = np.zeros(len(rep), np.int64), np.arange(len(rep))
    spanning: list[tuple] = []
    order = np.argsort(block, kind="stable")
    first = order[block[order] == i]
    second = order[block[order] == j]
    for start in range(0, len(first), 512):
        rows = first[start:start + 512]
        x, y = np.nonzero(units[rows] @ units[second].T >= threshold)
        a, b = rows[x], second[y]
        if i == j:
            a, b = a[a < b], b[a < b]
        fresh = _first_shared(one[a], two[b], leaf)
        a, b = a[fresh], b[fresh]
        np.add.at(count, a, weight[b])
        np.add.at(count, b, weight[a])
        spanning.append((a, b))
    a, b = (np.concatenate([s[k] for s in spanning]) if spanning else np.zeros(0, int) for k in (0, 1))
    while True:  # every vector takes the smallest place among those it links to, until nothing changes
        before = joined.copy()
        np.minimum.at(joined, a, joined[b])
        np.minimum.at(joined, b, joined[a])
        joined = joined[joined]
        if (joined == before).all():
            break
    linked = np.flatnonzero(count)
    return pa.table({"rep": rep[linked], "links": count[linked], "peer": rep[joined[linked]]})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf_rows: int = LEAF,
                 sample_rows: int = SAMPLE, block_rows: int = BLOCK) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal label link at a cosine of `threshold` or more. Equal vectors of a label are one class, compared once
    and counted as often as they occur; rows that repeat a vec_id are vectors of their own. A vector that is null, zero,
    or has null or non-finite components, or has no label, links with nothing, nor do vectors of different width.
    Trees are as deep as a leaf of `leaf_rows` vectors of the largest label needs. A leaf with more than twice `block_rows`
    is compared in blocks, every block with every other, so no pair of a leaf is left out and no task holds more than two
    blocks.
    """
    import numpy as np

    rows = vectors.select("vec_id", "embedding", "label")
    good = rows.where(usable())
    classes = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
                          .withColumn("width", F.size("embedding")).where("rep is not null"), "classes")
    largest = {r["width"]: r["most"] for r in classes.groupBy("width", "label").count().groupBy("width")
               .agg(F.max("count").alias("most")).collect()}
    forests = {}
    for width, most in largest.items():
        same = classes.where(F.col("width") == width)
        share = min(1.0, sample_rows / max(1, same.count()))
        taken = same.where(F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        sample = taken.select("embedding").toArrow().column(0).combine_chunks().flatten().to_numpy().astype(float).reshape(-1, width)
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        deepest = int(np.log2(max(1, len(sample) // SPLIT_ROWS)))
        depth = min(deepest, int(np.ceil(np.log2(max(1, most / leaf_rows)))))
        grown = [grow(sample, depth, SEED + 1000 * width + t, threshold) for t in range(trees if depth else 1)]
        # a tree whose root is dense compares all pairs, and needs no other beside it
        forests[width] = next(([t] for t in grown if depth and np.isposinf(t.low[0])), grown)
    routed = _routed(classes, forests)
    key = ["width", "label", "leaf"]
    sizes = materialize(routed.groupBy(*key).count(), "leaf-sizes").where("count > 1").withColumn(
        "blocks", F.when(F.col("count") > 2 * block_rows, F.ceil(F.col("count") / block_rows)).otherwise(1).cast("int"))
    placed = routed.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(SEED)), "blocks").cast("int"))
    paired = (placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    found = paired.groupBy(*key, "i", "j").applyInArrow(lambda t: _compare(t, threshold), "rep long, links long, peer long")
    found = materialize(found, "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    known = materialize(
        classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("root", "rep").alias("component_id")), "known")
    linked = good.join(known, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
