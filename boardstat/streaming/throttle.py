"""Request throttling over an event log: windows per key that open at the first request after the last one closed.

A window opens at a request, stays open for `window_ms`, and the next request strictly later than its end opens the next
one. Requests beyond `limit` in a window are rejected, and still counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from sys import modules
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The state step travels with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(modules[__name__])

OUTPUT = "key long, at_ms long, hits long, allowed long, rejected long, retry_after long"
NONE = -(2 ** 62)  # no opening
STATE = "count long, reset long"


def _step(at: int, hits: int, limit: int, window_ms: int, count: int, reset: int | None):
    """One moment of one key: (count, reset, allowed, rejected, retry_after)."""
    if reset is None or at > reset:
        count, reset = 0, at + window_ms
    allowed = max(0, min(hits, limit - count))
    rejected = hits - allowed
    retry = -(-(reset - at) // 1000) if rejected else 0
    return count + hits, reset, allowed, rejected, retry


def _hits(events: DataFrame, partners: Iterable[int], limit: int) -> DataFrame:
    """Requests per key and millisecond; keys of partners have ten times the limit."""
    tier = F.when(F.col("key").isin(list(partners)), limit * 10).otherwise(limit) if partners else F.lit(limit)
    return (events.groupBy("key", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
            .agg(F.count("*").alias("hits")).withColumn("limit", tier.cast("long")))


def _stretches(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """Rows sorted by (key, stretch) as one (key, stretch, arrays ...) per stretch, across batch limits."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        ends = (held[0][c].iloc[0] == batch[c].iloc[-1] for c in ("key", "stretch"))
        if all(ends):  # the stretch goes on: joined once, when it is whole
            continue
        rest = pd.concat(held, ignore_index=True)
        key, stretch = rest["key"].to_numpy(), rest["stretch"].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (stretch[1:] != stretch[:-1])) + 1)]
        arrays = [rest[c].to_numpy() for c in columns]
        for low, high in zip(cuts, cuts[1:]):
            yield key[low], stretch[low], *(a[low:high] for a in arrays)
        held = [rest.iloc[cuts[-1]:]]
    if held:
        rest = pd.concat(held, ignore_index=True)
        yield rest["key"].iloc[0], rest["stretch"].iloc[0], *(rest[c].to_numpy() for c in columns)


def _gathered(parts: Iterator[dict], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Small column sets as frames of a useful size."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(next(iter(part.values())))
        if size >= rows:
            yield pd.DataFrame({c: np.concatenate([p[c] for p in held]) for c in part})
            held, size = [], 0
    if held:
        yield pd.DataFrame({c: np.concatenate([p[c] for p in held]) for c in held[0]})


def throttle_events(events: DataFrame, limit: int = 60, window_ms: int = 60_000, partners: Iterable[int] = (),
                    slots: int = 256) -> DataFrame:
    """Decisions for a whole log of (key, ts), one row per key and millisecond.

    Where a window opens depends on where the one before it opened, but only through a single number. So each stretch of
    `slots` window lengths of a key is read on its own: for every moment that can open its first window it is worked out
    where its last one opens. Later first openings never lead to earlier last ones, so neighbours with the same outcome
    are one interval. Only these few intervals are followed from stretch to stretch in order; then each stretch marks its
    windows, and the requests of a window are counted by a plain window function. No task sees more than one stretch of
    a key, but for its intervals, and a stretch is bounded by its milliseconds, not by its requests.
    """
    length = window_ms + 1  # openings are further apart than a window, so at most one falls into a slot
    span = slots * length
    moments = _hits(events, partners, limit).withColumn("stretch", F.floor(F.col("at_ms") / span))

    def openings(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for key, stretch, at in _stretches(batches, "at_ms"):
            following = np.searchsorted(at, at + window_ms, "right")
            last = np.arange(len(at))
            for i in range(len(at) - 1, -1, -1):
                if following[i] < len(at):
                    last[i] = last[following[i]]
            first = min(len(at), int(np.searchsorted(at, stretch * span + length)) + 1)
            outcome = at[last[:first]]
            ends = np.flatnonzero(np.r_[outcome[1:] != outcome[:-1], True])
            yield {"key": np.full(len(ends), key), "stretch": np.full(len(ends), stretch), "entry": at[ends],
                   "last": outcome[ends]}

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, key, opened, found = None, None, NONE, True
        for batch in batches:
            rows = []
            for k, stretch, entry, last in batch.itertuples(index=False):
                if (k, stretch) != here:
                    opened = opened if k == key else NONE
                    here, key, found = (k, stretch), k, False
                    rows.append((k, stretch, opened))
                if not found and (opened == NONE or entry > opened + window_ms):
                    opened, found = last, True
            yield pd.DataFrame(rows, columns=["key", "stretch", "before"])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for key, _, at, hits, tier, before in _stretches(batches, "at_ms", "hits", "limit", "before"):
            starts = [before[0]]
            nxt = 0 if before[0] == NONE else int(np.searchsorted(at, before[0] + window_ms, "right"))
            while nxt < len(at):
                starts.append(at[nxt])
                nxt = int(np.searchsorted(at, at[nxt] + window_ms, "right"))
            place = np.maximum(np.searchsorted(np.array(starts), at, "right") - 1, 0)
            yield {"key": np.full(len(at), key), "at_ms": at, "hits": hits, "limit": tier,
                   "opened": np.array(starts)[place]}

    def in_order(df: DataFrame) -> DataFrame:
        # By a number of its own: rows joined by key and stretch count as placed by them already, and the exchange would be
        # left out, but a join that turns into a broadcast at run time reads its rows where they are and parts a stretch.
        return df.repartition(F.xxhash64("key", "stretch")).sortWithinPartitions("key", "stretch", "at_ms")

    lists = in_order(moments.select("key", "stretch", "at_ms")).mapInPandas(
        lambda batches: _gathered(openings(batches)), "key long, stretch long, entry long, last long")
    entries = (lists.repartition("key").sortWithinPartitions("key", "stretch", "entry")
               .mapInPandas(follow, "key long, stretch long, before long"))
    marked = in_order(moments.join(entries, ["key", "stretch"])).mapInPandas(
        lambda batches: _gathered(mark(batches)), "key long, at_ms long, hits long, limit long, opened long")
    earlier = Window.partitionBy("key", "opened").orderBy("at_ms").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("limit") - F.coalesce(F.sum("hits").over(earlier), F.lit(0))
    allowed = F.greatest(F.lit(0), F.least("hits", free)).cast("long")
    wait = F.ceil((F.col("opened") + window_ms - F.col("at_ms")) / 1000)
    return (marked.withColumn("allowed", allowed).withColumn("rejected", F.col("hits") - F.col("allowed"))
            .withColumn("retry_after", F.when(F.col("rejected") > 0, wait).otherwise(0))
            .select("key", "at_ms", "hits", "allowed", "rejected", "retry_after"))


def throttle_stream(events: DataFrame, limit: int = 60, window_ms: int = 60_000,
                    partners: Iterable[int] = ()) -> DataFrame:
    """The same decisions on a stream of (key, ts): two numbers of state per key, dropped once the window is over.

    Within a micro-batch the requests of a key are taken in time order; the state expires by event time, so a request
    later than the watermark allows opens a window of its own.
    """
    tiers = set(partners)

    def decide(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, None)
        tier = limit * 10 if key[0] in tiers else limit
        hits = pd.concat([b["at_ms"].value_counts() for b in batches]).groupby(level=0).sum().sort_index()
        rows = []
        for at, n in hits.items():
            count, reset, allowed, rejected, retry = _step(int(at), int(n), tier, window_ms, count, reset)
            rows.append((key[0], int(at), int(n), allowed, rejected, retry))
        state.update((count, reset))
        # One millisecond past the window, but never behind the watermark.
        state.setTimeoutTimestamp(max(reset + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "at_ms", "hits", "allowed", "rejected", "retry_after"])

    timed = events.withWatermark("ts", f"{window_ms} milliseconds").select(
        "key", "ts", F.unix_millis("ts").alias("at_ms"))
    return timed.groupBy("key").applyInPandasWithState(decide, OUTPUT, STATE, "append",
                                                       GroupStateTimeout.EventTimeTimeout)
