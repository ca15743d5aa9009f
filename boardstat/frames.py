"""Frame helpers shared by all operators: literal relations, the shared folder, staged tables, row numbering."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_staged: dict[tuple, DataFrame] = {}
_folders: dict[str, str] = {}
_runs: list[str] = []


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (tuple, list)):
        return f"array({', '.join(literal(v) for v in value)})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Sequence) -> Column:
    """A constant array as one expression."""
    return F.expr(literal(tuple(values)))


def literal_map(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in pairs.items()) + ")")


def literal_frame(spark: SparkSession, schema: dict[str, str], rows: Sequence[Sequence]) -> DataFrame:
    """Fixed rows as a literal relation, whose exact size the optimizer knows."""
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    frame = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema)})")
    return frame.select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        _folders[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _folders[app]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the JVM may be gone already; what is left is one folder named after the application
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which is removed when the application ends."""
    app = f"{shared_folder(spark)}/boardstat-{spark.sparkContext.applicationId}"
    if app not in _folders:
        _folders[app] = app
        atexit.register(_remove_at_exit, spark, app)
    return f"{_runs[-1] if _runs else app}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: for jobs that keep nothing but their own output."""
    folder = fresh_path(spark, "job")
    _runs.append(folder)
    try:
        yield
    finally:
        _runs.remove(folder)
        remove(spark, folder)


def write_table(df: DataFrame, name: str, by: Sequence[str] = ()) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return path


def materialize(df: DataFrame, name: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage: the rows survive the loss of any executor because they are in the shared folder. `by` names the
    columns of its partitions, one folder per value."""
    path = write_table(df, name, by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def staged(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame],
           by: Sequence[str] = ()) -> DataFrame:
    """A table derived once per application from the tables under `source`, then read back by every query.

    With `by`, columns of values bounded by the calendar, filters on them and joins with filtered rows of them read their
    own folders only. Rows are written where they are: frames grouped or numbered by such a column hold it in few tasks.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _staged:
        _staged[key] = materialize(build(), name, by)
    return _staged[key]


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str) -> DataFrame:
    """Exact 1-based positions inside each key, for groups of any size.

    A window over a key would bring a hot group to one task. Here the rows are sorted in ranges over
    (keys, order), so a hot group spans many tasks, and stored with their places: a row's place in its range, counted
    from its group's first one there, and the count of the earlier ranges of the same group give its position. The rows
    move once; what is added to their places is a table of one row per group and range. `order` must be total inside a key.
    """
    by = [F.col(k) for k in keys] + list(order)
    # The upper bits of such a number are the task, the lower 33 the place in it.
    sorted_ranges = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranges = materialize(sorted_ranges, "ranges").withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    starts = parts.select(*keys, "_range", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return (ranges.join(materialize(starts, "starts"), [*keys, "_range"])
            .withColumn(column, F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_range"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key. The rank limit is applied before the shuffle, so hot keys send one row per task."""
    return top_per_key(df, keys, order, 1).drop("position")


SALTS = 64


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, column: str = "position",
                spread: str | None = None) -> DataFrame:
    """The first k rows of every key with their positions.

    Every task sends at most k rows of a key. For a large k, `spread` names an id column: a hot key is first cut down
    in many parts by that id, so the last step sees a fixed number of rows however many tasks read the key.
    """
    place = F.row_number()
    if spread:
        salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
        parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_place", place.over(parts)).where(F.col("_place") <= k).drop(
            "_salt", "_place")
    return df.withColumn(column, place.over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(column) <= k)
