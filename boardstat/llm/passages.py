"""Substring deduplication by repeated-phrase automata.

A window is 13 consecutive words. The windows that occur in several documents are confirmed, compiled into sharded
Aho-Corasick automata over words, and all occurrences are located by streaming the documents through them; every word
under a window that a document with a smaller id has too is removed.

No window is shuffled on its own. A window is represented by its seed, the four words of smallest hash in it, so equal
windows have the same seed, and neighbours mostly share one: consecutive windows with one seed in common are a stretch
of at most 22 words. Only stretches whose seed several documents have can hold repeated windows; they go to the shard
of their seed, each distinct one once, where the automaton of the shard's repeated windows reads them.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardstat.frames import materialize

from .shared import as_bytes, lean, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SEED_WORDS = 13, 4
#: Stretches whose windows one automaton is compiled from.
SHARD = 16_384
#: Rows that a task holds to combine equal ones before a shuffle.
HELD = 1 << 20
_KEPT = "n_words long, n_removed long, kept string"


def _batch_words(texts: pa.Array):
    """The words of all texts as one array, their number in each text, and a hash of each word."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null("")))
    sizes, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # a blank text is one empty word
        sizes -= np.add.reduceat(empty, np.cumsum(sizes) - sizes) if len(sizes) else 0
        words = words.filter(pa.array(~empty))
    column = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in column.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    return words, sizes, hashes[column.indices.to_numpy()]


def _mix(hashes, n: int):
    """A hash of the n words that begin at each place."""
    import numpy as np

    size = max(len(hashes) - n + 1, 0)
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total = (total ^ hashes[j:j + size]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _window_seeds(texts: pa.Array):
    """(words, words before each text, window starts, their text numbers, seed places, seed hashes) of all windows."""
    import numpy as np

    words, sizes, hashes = _batch_words(texts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    short = _mix(hashes, SEED_WORDS)
    size = max(len(words) - WINDOW + 1, 0)
    # the low bits hold the place inside the window, so the leftmost of equal hashes is the least
    best = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    high = short & ~np.uint64(15)
    for j in range(WINDOW - SEED_WORDS + 1):
        np.minimum(best, high[j:j + size] | np.uint64(j), out=best)
    places = np.arange(size) + (best & np.uint64(15)).astype(np.int64)
    starts = np.flatnonzero(owner[:size] == owner[WINDOW - 1:WINDOW - 1 + size])
    return words, np.cumsum(sizes) - sizes, starts, owner[starts], places[starts], short[places[starts]].view(np.int64)


def _runs(*columns):
    """First index of each run of equal rows, and the end of the last."""
    import numpy as np

    change = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate([[0] * (len(columns[0]) > 0), np.flatnonzero(change) + 1]).astype(np.int64)


def seeds(texts: DataFrame) -> DataFrame:
    """(row, seed, known) of all windows of (row, text) rows: known if the task has met the seed in another text too.

    Of the texts that share a seed in one task one more row, not known, stands for all towards other tasks, so a seed
    that many documents have sends few rows to its place.
    """

    def combined(held):
        import numpy as np

        rows, seed = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((rows, seed))
        rows, seed = rows[order], seed[order]
        once = _runs(seed, rows)
        rows, seed = rows[once], seed[once]
        begin = _runs(seed)
        sizes = np.diff(np.append(begin, len(seed)))
        known = np.repeat(sizes > 1, sizes)
        stand = begin[sizes > 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rows, rows[stand]])), pa.array(np.concatenate([seed, seed[stand]])),
             pa.array(np.concatenate([known, np.zeros(len(stand), bool)]))], ["row", "seed", "known"])

    def find(batches):
        held, size = [], 0
        for batch in small_batches(batches):
            rows = batch.column(0).to_numpy()
            *_, owner, _, seed = _window_seeds(batch.column(1))
            first = _runs(owner, seed)
            held.append((rows[owner[first]], seed[first]))
            size += len(first)
            if size >= HELD:
                yield combined(held)
                held, size = [], 0
        if held:
            yield combined(held)

    return texts.mapInArrow(find, "row long, seed long, known boolean")


def shared_seeds(found: DataFrame) -> DataFrame:
    """(row, seeds): for every text the seeds that another text has too, if there are any."""
    # known rows are spread, the others meet by seed and look at their neighbours only
    place = F.when(F.col("known"), F.col("row")).otherwise(F.col("seed"))
    near = Window.partitionBy("known", "place").orderBy("row")
    # of rows that repeat a text, one next to another text is enough
    several = (F.lag("row").over(near) < F.col("row")) | (F.lead("row").over(near) > F.col("row"))
    shared = found.withColumn("place", place).withColumn("several", several).where(
        F.col("known") | F.coalesce("several", F.lit(False)))
    return shared.groupBy("row").agg(F.collect_set("seed").alias("seeds"))


def identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, row, check, text): two independent hashes tell texts apart, the first alone names a text in narrow tables."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("row"),
                       F.xxhash64(F.lit("check"), text).alias("check"), text.alias("text"))


def packed(texts: DataFrame) -> DataFrame:
    """The same rows with the text compressed, for a shuffle."""

    def pack(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([squeeze(t) for t in as_bytes(batch.column(3))], pa.binary())],
                ["id", "row", "check", "packed"])

    return texts.mapInArrow(pack, "id long, row long, check long, packed binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


def stretches(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, row, seed, at, text): the stretches of packed texts around shared seeds; `at` is the first word's place."""

    def cut(batches):
        import numpy as np
        import pyarrow.compute as pc

        for batch in small_batches(batches, 256):
            ids, rows = (batch.column(k).to_numpy() for k in (0, 1))
            wanted = batch.column(3)
            holder = np.repeat(np.arange(len(batch)), wanted.value_lengths().to_numpy())
            wanted = wanted.flatten().to_numpy()
            words, before, starts, owner, places, seed = _window_seeds(pa.array(_unpacked(batch.column(2)), pa.large_binary()))
            runs = _runs(owner, places)
            lasts = np.append(runs[1:], len(starts))[:len(runs)] - 1
            hit = np.isin(_pairs(owner[runs], seed[runs]), _pairs(holder, wanted))
            runs, lasts = runs[hit], lasts[hit]
            begin, sizes = starts[runs], starts[lasts] - starts[runs] + WINDOW
            ends = sizes.cumsum()
            take = np.repeat(begin - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), words.take(pa.array(take)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner[runs]]), pa.array(rows[owner[runs]]), pa.array(seed[runs]),
                 pa.array((begin - before[owner[runs]]).astype(np.int32)),
                 pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())], ["id", "row", "seed", "at", "text"])

    rows = texts.join(shared, ["id", "row", "check"]).select("id", "row", "packed", "seeds")
    return rows.mapInArrow(cut, "id long, row long, seed long, at int, text string").withColumn("stretch", F.xxhash64("text"))


def _distinct(*columns):
    """(first index of each distinct row, number of its distinct row for each row)."""
    import numpy as np

    order = np.lexsort(columns[::-1])
    begin = _runs(*(c[order] for c in columns))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    return order[begin], which


def _pairs(a, b):
    """One number per (text number, seed)."""
    import numpy as np

    return b.view(np.uint64) ^ (a.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sharded(held: DataFrame, shard: int) -> DataFrame:
    """(seed, stretch, text, low, high, slots, slot, shard): stretches with the least and the largest id that has them,
    each once per task, about `shard` to a shard and all of a seed in one. A seed with more of them has several slots,
    by a hash of the window; its stretches go to the slots of their windows."""
    shards = max(1, -(-held.count() // shard))
    heavy = held.groupBy("seed").agg(F.count("*").alias("rows")).where(F.col("rows") > shard)
    heavy = materialize(heavy.select("seed", F.ceil(F.col("rows") / shard).cast("int").alias("slots")), "heavy")
    names = ["seed", "stretch", "text", "low", "high", "slots", "slot"]

    def combined(batches):
        import numpy as np
        import xxhash

        table = pa.Table.from_batches(batches)
        seed, stretch, ids = (table.column(c).to_numpy() for c in ("seed", "stretch", "id"))
        first, which = _distinct(seed, stretch)
        low, high = ids[first], ids[first]
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        slots = table.column("slots").to_numpy()[first]
        texts = table.column("text").take(pa.array(first)).combine_chunks()
        slot = [(0,)] * len(first)
        for k in np.flatnonzero(slots > 1).tolist():
            words, n = texts[k].as_py().split(" "), int(slots[k])
            slot[k] = sorted({xxhash.xxh64_intdigest(" ".join(words[i:i + WINDOW])) % n for i in range(len(words) - WINDOW + 1)})
        take = np.repeat(np.arange(len(first)), [len(x) for x in slot])
        columns = [seed[first], stretch[first], texts, low, high, slots]
        columns = [c.take(pa.array(take)) if c is texts else pa.array(c[take]) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x for xs in slot for x in xs], pa.int32())], names)

    def combine(batches):
        waiting = []
        for batch in lean(batches):
            waiting.append(batch)
            if sum(map(len, waiting)) >= HELD >> 2:
                yield combined(waiting)
                waiting = []
        if waiting:
            yield combined(waiting)

    rows = held.join(heavy, "seed", "left").select("id", "seed", "stretch", "text", F.coalesce("slots", F.lit(1)).alias("slots"))
    once = rows.mapInArrow(combine, "seed long, stretch long, text string, low long, high long, slots int, slot int")
    return once.withColumn("shard", F.pmod(F.xxhash64("seed", "slot"), F.lit(shards)))


def located(shards: DataFrame) -> DataFrame:
    """(seed, stretch, firsts): for each window of each distinct stretch the smallest id of the documents that hold it,
    null if no other does. One automaton per shard: compiled from the windows of several documents, run over all
    stretches of the shard. A heavy seed's stretches have a row per slot, each with the windows of that slot."""

    def locate(table: pa.Table) -> pa.Table:
        import ahocorasick
        import numpy as np
        import pyarrow.compute as pc
        import xxhash

        lists = pc.split_pattern(table.column("text").combine_chunks().cast(pa.large_string()), " ")
        sizes, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
        begins = sizes.cumsum() - sizes
        # every word of the shard is one character of a string over all its stretches, so equal characters mean equal
        # words; surrogates are left out, and the first character parts the stretches
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        codes += np.where(codes < 0xD800, 0, 0x800)
        owner = np.repeat(np.arange(len(sizes)), sizes - WINDOW + 1)
        local = np.arange(len(owner)) - np.repeat((sizes - WINDOW + 1).cumsum() - (sizes - WINDOW + 1), sizes - WINDOW + 1)
        at = begins[owner] + local
        slots = table.column("slots").to_numpy()
        if (slots > 1).any():
            texts, slot = [w.as_py() for w in words], table.column("slot").to_numpy()
            mine = np.array([xxhash.xxh64_intdigest(" ".join(texts[p:p + WINDOW])) % n == s
                             for p, n, s in zip(at.tolist(), slots[owner].tolist(), slot[owner].tolist())])
            owner, at = owner[mine], at[mine]
        distinct, first, which = np.unique(_mix(codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), WINDOW)[at],
                                           return_index=True, return_inverse=True)
        least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, which, table.column("low").to_numpy()[owner])
        np.maximum.at(most, which, table.column("high").to_numpy()[owner])
        confirmed = np.flatnonzero(least < most)
        line = np.zeros(len(codes) + len(sizes), "<u4")
        shift = np.repeat(np.arange(len(sizes)), sizes)
        line[np.arange(len(codes)) + shift] = codes
        line = line.tobytes().decode("utf-32-le")
        found, known = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        if len(confirmed):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            place = at[first[confirmed]]
            for k, p in zip(confirmed.tolist(), (place + shift[place]).tolist()):
                automaton.add_word(line[p:p + WINDOW], k)
            automaton.make_automaton()
            hits = np.fromiter((x for hit in automaton.iter(line) for x in hit), np.int64).reshape(-1, 2)
            ends = hits[:, 0] - np.searchsorted(begins + np.arange(len(sizes)), hits[:, 0], "right") + 1
            found[ends - WINDOW + 1], known[ends - WINDOW + 1] = least[hits[:, 1]], True
        # a stretch that several tasks have sent is answered once
        once = np.sort(_distinct(*(table.column(c).to_numpy() for c in ("seed", "stretch", "slot")))[0])
        held = once[np.add.reduceat(known, begins)[once] > 0]
        lengths = sizes[held] - WINDOW + 1
        offsets = np.append(0, lengths.cumsum())
        take = np.repeat(begins[held] - offsets[:-1], lengths) + np.arange(int(lengths.sum()))
        firsts = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found[take], mask=~known[take]))
        return pa.table({"seed": table.column("seed").take(pa.array(held)),
                         "stretch": table.column("stretch").take(pa.array(held)), "firsts": firsts})

    return shards.groupBy("shard").applyInArrow(locate, "seed long, stretch long, firsts array<long>")


def finished(table: DataFrame) -> None:
    """The shuffles of a table that is written are of no more use; Spark drops them when the driver's JVM collects."""
    table.sparkSession._jvm.System.gc()


def removals(texts: DataFrame, firsts: DataFrame, shard: int = SHARD) -> DataFrame:
    """(id, row, starts): the places of the windows to remove, of the first holder of every text that has some."""
    shared = shared_seeds(seeds(texts.select("row", "text"))).join(firsts, "row")
    held = materialize(stretches(packed(texts), shared), "stretches")
    finished(held)
    places = located(sharded(held, shard))
    hit = held.select("id", "row", "seed", "stretch", "at").join(places, ["seed", "stretch"])
    starts = F.filter(F.transform("firsts", lambda f, i: F.when(f < F.col("id"), F.col("at") + i)), lambda x: x.isNotNull())
    hit = hit.select("id", "row", starts.alias("starts")).where(F.size("starts") > 0)
    return hit.groupBy("id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    shard: int = SHARD) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept (the words left, joined by one space).

    Words are runs of bytes other than ASCII white space, unchanged; null and blank texts have none. A word goes if one
    of the windows over it begins in a document with a smaller id too, judged on the whole input. Texts of fewer than
    13 words stay. Rows that share an id never remove words from each other; rows without an id neither lose words nor
    remove any. Whole texts of any length are read; other columns are not.

    Of equal texts only the first holder's is searched: all windows of the others stand there already.
    """
    texts = identified(docs, id_column, text_column)
    known = texts.where("id is not null")
    firsts = materialize(known.groupBy("row", "check").agg(F.min("id").alias("id")), "firsts")
    places = materialize(firsts.join(removals(known, firsts, shard), ["id", "row"], "left")
                         .select("id", "row", "check", F.coalesce("starts", F.array().cast("array<int>")).alias("starts")), "removals")
    finished(places)

    def cut(batches):
        import numpy as np

        for batch in small_batches(batches, 128):
            out = []
            for text, starts in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
                words = kept = text.split()
                if starts is None and len(words) >= WINDOW:
                    kept = []
                elif starts:
                    change = np.zeros(len(words) + 1, np.int64)
                    places = np.unique(starts)
                    change[places] += 1
                    change[places + WINDOW] -= 1
                    kept = [words[k] for k in np.flatnonzero(change.cumsum()[:-1] == 0).tolist()]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    # a row that is no first holder of its text finds no places
    found = packed(known).join(places, ["id", "row", "check"], "left").select("id", "packed", "starts")
    rest = packed(texts.where("id is null")).select("id", "packed", F.array().cast("array<int>").alias("starts"))
    return found.union(rest).mapInArrow(cut, f"id long, {_KEPT}").withColumnRenamed("id", id_column)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM s),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, i + k AS i FROM g JOIN f ON g.g = f.g, (SELECT unnest(range(0, 13)) AS k) WHERE first < doc_id),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (SELECT p.r, string_agg(x, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN gone ON p.r = gone.r AND p.i = gone.i GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r"""
