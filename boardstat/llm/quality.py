"""Document quality: random Fourier features over document statistics, ridge scores, isotonic calibration.

Each whole text gives a vector of statistics. Cosines of random projections of the scaled vector approximate a Gaussian
kernel; the ridge weights solve normal equations whose sums are taken per partition and then added up. A held-back part
of the labelled rows calibrates the raw scores by isotonic regression over a histogram of scores.
"""

from __future__ import annotations

import operator
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardstat.frames import materialize

from .shared import as_bytes, slices, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bound of the labelled rows that a model is fitted on; beyond it rows are taken by a hash of their id.
TRAINING_ROWS = 200_000
FEATURES = 256
RIDGE = 1e-3
SEED = 7
THRESHOLD = 0.3
#: Raw scores of the calibration part are counted in steps of this width.
STEP = 0.002
_SYMBOLS = b"#$%&*+/<=>@\\^_`|~{}[]"
STATISTICS = 26


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text; all zero for a text without words."""
    import math
    from collections import Counter

    import numpy as np

    bytes_seen = np.zeros(256, np.int64)
    words: Counter = Counter()
    lines: Counter = Counter()
    repeats = ended = marked = shouted = squares = 0
    previous = None
    for start in range(0, len(text), 1 << 20):
        bytes_seen += np.bincount(np.frombuffer(text[start:start + (1 << 20)], np.uint8), minlength=256)
    for part in slices(text, 1 << 20):
        found = part.split()
        words.update(found)
        lines.update(part.split(b"\n"))
        repeats += sum(map(operator.eq, found, [previous, *found[:-1]])) if found else 0
        previous = found[-1] if found else previous
    n_words, n_bytes = words.total(), len(text)
    if not n_words:
        return [0.0] * STATISTICS
    for word, n in words.items():
        last = word[-1]
        squares += n * len(word) ** 2
        ended += n * (last in b".,;:?!")
        marked += n * (last in b"#$%&*!|")
        shouted += n * (len(word) > 1 and word.isupper())
    spaces = int(bytes_seen[9:14].sum() + bytes_seen[32])
    shown = n_bytes - spaces
    share = bytes_seen[bytes_seen > 0] / n_bytes
    word_share = np.fromiter(words.values(), float, len(words)) / n_words
    mean = shown / n_words
    full = [v for k, v in lines.items() if k.strip()]
    n_lines = max(1, sum(full))
    count = lambda chars: float(bytes_seen[list(chars)].sum()) / shown
    return [
        math.log1p(n_bytes), math.log1p(n_words), mean, math.sqrt(max(0.0, squares / n_words - mean * mean)),
        spaces / n_bytes, count(range(128, 256)), count(range(48, 58)), count(range(65, 91)), count(range(97, 123)),
        count(b".?"), count(b",;:"), count(b"!"), count(_SYMBOLS), count(b"'\"()-"), count(b"|"),
        math.log1p(n_lines), n_words / n_lines, 1 - len(full) / n_lines, max(full, default=0) / n_lines,
        len(words) / n_words, float(word_share.max()), -float((word_share * np.log(word_share)).sum()),
        repeats / n_words, -float((share * np.log(share)).sum()), (ended - marked) / n_words, shouted / n_words,
    ]


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, stats) per row; a null text counts as empty."""
    kind = dict(docs.dtypes)[id_column]

    def measure(batches):
        for batch in small_batches(batches):
            rows = [statistics(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             [id_column, "stats"])

    return docs.select(id_column, text_column).mapInArrow(measure, f"`{id_column}` {kind}, stats array<double>")


def fold(id_column: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5


@dataclass
class Model:
    """Scale of the statistics, random projections, ridge weights and the calibration curve; without labels to learn
    from, `weights` is None and every score is 0.5."""

    mean: object = None
    scale: object = None
    projections: object = None
    shifts: object = None
    weights: object = None
    raw: object = None
    calibrated: object = None

    def features(self, stats):
        import numpy as np

        scaled = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(scaled @ self.projections + self.shifts) * np.sqrt(2 / FEATURES)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def score(self, stats):
        """Calibrated scores from 0 to 1. A thousandth of the raw score orders rows on a flat part of the curve."""
        import numpy as np

        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.features(stats) @ self.weights
        return np.clip(0.999 * np.interp(raw, self.raw, self.calibrated) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _matrix(column: pa.Array):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(points: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over (position, weight, sum of labels) by position: centres and values of the blocks."""
    blocks: list[list[float]] = []
    for position, weight, total in sorted(points):
        blocks.append([position * weight, weight, total])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return [b[0] / b[1] for b in blocks], [b[2] / b[1] for b in blocks]


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality",
        max_rows: int = TRAINING_ROWS) -> Model:
    """A model from labelled rows whose fold is not 0: four of five teach the ridge, every fifth calibrates.

    Labels that are null are left out, several of one document are averaged. The fit uses at most about `max_rows`
    rows, chosen by a hash of the id; what reaches the driver are sums whose size depends on FEATURES and STEP only.
    """
    import numpy as np

    taught = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column)
              .agg(F.avg(F.col(label_column).cast("double")).alias("y")))
    known = stats.join(taught.where(fold(id_column) != 0), id_column).select(id_column, "stats", "y")
    known = materialize(known, "labelled")
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(id_column), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    part = F.pmod(F.xxhash64(F.lit(SEED), id_column), F.lit(5))
    teach = known.where(part != 0).select("stats", "y", F.xxhash64(id_column).alias("at"))
    if not teach.take(1):
        return Model()
    moments = teach.select("y", F.posexplode("stats")).groupBy("pos").agg(
        F.avg("col").alias("mean"), F.stddev_pop("col").alias("scale")).orderBy("pos").collect()
    draw = np.random.default_rng(SEED)
    model = Model(np.array([m["mean"] for m in moments]), np.array([m["scale"] or 1.0 for m in moments]) + 1e-9)
    width = 1 / np.sqrt(STATISTICS)
    model.projections = draw.normal(0, width, (STATISTICS, FEATURES))
    model.shifts = draw.uniform(0, 2 * np.pi, FEATURES)

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in small_batches(batches):
            if len(batch):
                z = model.features(_matrix(batch.column(0)))
                total += z.T @ np.column_stack([z, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total))],
                                         ["line", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = _matrix(table.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"line": table.column("line")[:1], "sums": pa.array([total])})

    spread = teach.repartition(max(1, min(32, n // 4096)), "at")
    lines = (spread.select("stats", "y").mapInArrow(sums, "line int, sums array<double>").groupBy("line")
             .applyInArrow(add, "line int, sums array<double>").collect())
    equations = np.array([r["sums"] for r in sorted(lines, key=lambda r: r["line"])])
    gram = equations[:, :-1]
    penalty = RIDGE * gram[-1, -1] * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + penalty, equations[:, -1])

    def raw(batches):
        for batch in small_batches(batches):
            values = model.features(_matrix(batch.column(0))) @ model.weights if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(values), batch.column(1)], ["raw", "y"])

    held = known.where(part == 0).select("stats", "y").mapInArrow(raw, "raw double, y double")
    step = F.round(F.least(F.greatest("raw", F.lit(-2.0)), F.lit(3.0)) / STEP).cast("int")
    points = held.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    model.raw, model.calibrated = isotonic([(p["step"] * STEP, p["n"], p["y"]) for p in points]) if points else ([0, 1], [0, 1])
    return model


def scored(stats: DataFrame, model: Model, id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) per row of statistics."""
    kind = dict(stats.dtypes)[id_column]

    def score(batches):
        for batch in small_batches(batches):
            values = model.score(_matrix(batch.column(1))) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], [id_column, "score"])

    rows = stats.select(id_column, "stats").mapInArrow(score, f"`{id_column}` {kind}, score double")
    return rows.select(id_column, (fold(id_column) == 0).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Whole texts are read once; repeated rows are scored
    each; with an empty table of labels every score is 0.5."""
    stats = materialize(document_statistics(docs), "statistics")
    return scored(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. Texts are read a second time rather than shuffled;
    the batch of a row is measured, scored and filtered in place."""
    model = fit(materialize(document_statistics(docs), "statistics"), labels)
    columns = docs.columns

    def keep(batches):
        at = columns.index("text")
        for batch in small_batches(batches):
            if len(batch):
                import numpy as np

                rows = np.array([statistics(t) for t in as_bytes(batch.column(at))])
                yield batch.filter(pa.array(model.score(rows) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
