"""Continuous ingest of announcements that touches what changed only.

The rules of precedence need three facts about a cycle: whether it is frozen by a manual row, and whether an official and
a mirror row have been seen. They are keyed state of the stream, so a batch reads no stored cycle. The stored cycles come
first, as a stream of their own. Under the target folder a batch n writes `decided/version=n`, what became of each
announcement, and `changes/version=n`, one row per changed cycle. A snapshot is the latest change per cycle over the last
base; now and then the changes are folded into a new base, and what lies before the base before it is dropped. A batch
that is run again after a failure overwrites its own versions with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from sys import modules
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..frames import number_rows, remove, scratch
from ..functions import links
from ..operators.ingest import STATS, checked_announcements
from ..operators.writes import CYCLE_KEY

# The state step travels with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(modules[__name__])

ANNOUNCEMENT = ("exam_code string, year int, month string, url string, source string, title string, html string, "
                "arrival long")
CYCLE = ("id long, program_id long, month string, year int, total_takers int, total_passers int, pass_rate double, "
         "source_url string")
_DECIDED = ("program_id long, month string, year int, arrival long, exam_code string, url string, source string, "
            "total_takers int, total_passers int, pass_rate double, reason string, accepted boolean, known boolean")
_STATE = "known boolean, frozen boolean, official boolean, mirror boolean"
#: Batches between two bases.
COMPACT_EVERY = 16


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions under a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [entry.getPath().getName() for entry in system.listStatus(path)]
    return sorted(int(name.removeprefix("version=")) for name in found if name.startswith("version="))


def _base(target: str, version: int) -> str:
    """The start is the base before the first batch, and a stream of its own."""
    return f"{target}/start" if version < 0 else f"{target}/base/version={version}"


def _bases(spark: SparkSession, target: str) -> list[int]:
    return [-1, *versions(spark, f"{target}/base")]


def start_snapshots(cycles: DataFrame, target: str) -> None:
    """The cycles before the first batch."""
    wanted = [c.split()[0] for c in CYCLE.split(", ")]
    cycles.select(wanted).write.mode("overwrite").parquet(_base(target, -1))
    spark = cycles.sparkSession
    spark.read.schema(CYCLE).parquet(_base(target, -1)).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).coalesce(
        1).write.mode("overwrite").parquet(f"{target}/tops/version=-1")


def snapshot(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The cycles after a batch, the last one by default: base rows under the latest change of their cycle."""
    bases, changes = _bases(spark, target), versions(spark, f"{target}/changes")
    last = max(bases + changes) if version is None else version
    return _snapshot(spark, target, last, max(v for v in bases if v <= last))


def _snapshot(spark: SparkSession, target: str, version: int, base: int) -> DataFrame:
    rows = spark.read.schema(CYCLE).parquet(_base(target, base)).withColumn("version", F.lit(-2))
    later = [v for v in versions(spark, f"{target}/changes") if base < v <= version]
    if later:
        number = F.regexp_extract("_metadata.file_path", r"version=(\d+)", 1).cast("int")
        rows = rows.unionByName(spark.read.schema(CYCLE).parquet(*[f"{target}/changes/version={v}" for v in later])
                                .withColumn("version", number))
    columns = [c.split()[0] for c in CYCLE.split(", ")]
    values = F.struct(*[c for c in columns if c not in (*CYCLE_KEY, "id")])
    picked = rows.groupBy(*CYCLE_KEY).agg(F.max("id").alias("id"), F.max_by(values, "version").alias("row"))
    return picked.select(*[c if c in (*CYCLE_KEY, "id") else F.col(f"row.{c}").alias(c) for c in columns])


def status(spark: SparkSession, target: str, version: int) -> DataFrame:
    """What became of the announcements of a batch."""
    rows = spark.read.schema(_DECIDED).parquet(f"{target}/decided/version={version}")
    detail = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.col("accepted"), "existing official row (no overwrite)")
    return rows.select("arrival", "exam_code", "year", "month", F.when(F.col("accepted"), "saved").otherwise("skipped").alias("status"),
                       detail.alias("detail"))


def _decide(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Announcements of one cycle in order of arrival; a stored row comes first and only sets the state."""
    known, frozen, official, mirror = state.get if state.exists else (False, False, False, False)
    rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")
    accepted, before = [], []
    for kind, stored in zip(rows["cls"].tolist(), rows["stored"].tolist()):
        before.append(known)
        if kind < 0:  # refused, or a stored shell, which stands in no way
            accepted.append(False)
            known = known or stored
            continue
        if kind == 5:
            ok = not frozen and not official
            frozen = frozen or not official
        elif frozen:
            ok = False
        else:
            ok = kind == 3 or not official and (kind == 2 or not mirror)
        # a frozen cycle stays frozen whatever arrives, so its later rows need not be told apart
        official, mirror = official or kind == 3 and not frozen, mirror or kind in (1, 2)
        accepted.append(ok and not stored)
        known = known or stored or ok
    if known or frozen or official or mirror:
        state.update((bool(known), bool(frozen), bool(official), bool(mirror)))
    rows = rows.assign(accepted=accepted, known=before)
    yield rows[~rows["stored"]][[c.split()[0] for c in _DECIDED.split(", ")]]


def _store(target: str, compact_every: int) -> Callable[[DataFrame, int], None]:
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/decided/version={number}")
        accepted = spark.read.schema(_DECIDED).parquet(f"{target}/decided/version={number}").where("accepted")
        row = F.struct(*STATS, F.col("url").alias("source_url"))
        changed = accepted.groupBy(*CYCLE_KEY).agg(F.max_by(row, "arrival").alias("row"), F.min("arrival").alias("arrival"),
                                                   F.bool_and("known").alias("known"))
        top = spark.read.schema("top long").parquet(f"{target}/tops/version={number - 1}").first()["top"]
        with scratch(spark):
            fresh = number_rows(changed.where("not known"), [], [F.asc("arrival"), *map(F.asc, CYCLE_KEY)], "n")
            rows = changed.where("known").withColumn("id", F.lit(None).cast("long")).drop("arrival", "known").unionByName(
                fresh.withColumn("id", F.col("n") + top).drop("arrival", "known", "n"))
            rows.select("id", *CYCLE_KEY, "row.*").write.mode("overwrite").parquet(f"{target}/changes/version={number}")
        new = spark.read.schema(CYCLE).parquet(f"{target}/changes/version={number}")
        new.agg(F.coalesce(F.max("id"), F.lit(top)).alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{target}/tops/version={number}")
        if (number + 1) % compact_every == 0:
            compact(spark, target, number)
    return store


def compact(spark: SparkSession, target: str, version: int) -> None:
    """A new base of all changes up to a version; the base before it stays, with the changes that follow it."""
    last = max(v for v in _bases(spark, target) if v < version)
    _snapshot(spark, target, version, last).write.mode("overwrite").parquet(_base(target, version))
    for folder in ("base", "changes", "tops"):
        for v in versions(spark, f"{target}/{folder}"):
            if v < last or folder == "changes" and v == last:
                remove(spark, f"{target}/{folder}/version={v}")
    if last >= 0:  # the stream of the start has been read; its folder must be there when the stream is started again
        remove(spark, _base(target, -1))
        path = spark._jvm.org.apache.hadoop.fs.Path(_base(target, -1))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def stream_ingest(spark: SparkSession, path: str, programs: DataFrame, target: str, checkpoint: str,
                  schema: str = ANNOUNCEMENT, files_per_batch: int = 1000, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Ingest JSON announcements arriving in a folder; stops when what is there has been read.

    Announcements of one cycle are taken in order of arrival inside a batch, and batch after batch. The state is one
    row of four flags per cycle.
    """
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    known = programs.select(F.col("id").alias("program_id"), "exam_code")
    checked = checked_announcements(pages).join(known, "exam_code", "left")
    refused = F.col("reason").isNotNull()
    month = F.when(refused, F.col("month")).otherwise(F.col("final_month"))
    # a refused row is a group of its own and leaves no state
    rows = checked.where(refused | F.col("program_id").isNotNull()).select(
        "program_id", month.alias("month"), "year", "arrival", "exam_code", "url", "source", *[F.col(c) for c in STATS], "reason",
        F.when(refused, F.col("arrival")).alias("lane"), F.lit(False).alias("stored"),
        F.when(refused, -1).otherwise(links.source_priority(F.col("source"))).cast("int").alias("cls"))
    start = spark.readStream.schema(CYCLE).parquet(_base(target, -1))
    nothing = F.lit(None).cast("string")
    counts = F.coalesce("total_takers", F.lit(0)) > 0
    held = start.select(
        "program_id", "month", "year", F.lit(-1).cast("long").alias("arrival"), nothing.alias("exam_code"), nothing.alias("url"),
        nothing.alias("source"), *[F.col(c) for c in STATS], nothing.alias("reason"), F.lit(None).cast("long").alias("lane"),
        F.lit(True).alias("stored"), F.when(counts, F.when(links.is_manual(F.col("source_url")), 5).otherwise(
            links.stored_priority(F.coalesce("source_url", F.lit(""))))).otherwise(-1).cast("int").alias("cls"))
    decided = rows.unionByName(held).groupBy(*CYCLE_KEY, "lane").applyInPandasWithState(
        _decide, _DECIDED, _STATE, "append", GroupStateTimeout.NoTimeout)
    return (decided.writeStream.foreachBatch(_store(target, compact_every)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
