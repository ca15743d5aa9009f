import zlib

import numpy as np
import pytest

from boardstat.llm import quality

from .fixtures import ODD_TEXTS, documents

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores)) + 1
    good = labels.sum()
    return (ranks[labels == 1].sum() - good * (good + 1) / 2) / (good * (len(labels) - good))


def test_held_out_rows_are_told_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert auc(*map(np.array, zip(*held))) > 0.97


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0, 1 - quality, quality) quality")
    one, two = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)


def test_odd_documents_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(documents(spark), none).collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)}
    kept = quality.keep_good(documents(spark), none)
    assert kept.columns == documents(spark).columns and kept.count() == len(ODD_TEXTS) + 2
    few = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality_scores(documents(spark), few).collect())
    assert quality.quality_scores(documents(spark, []), few).collect() == []


def test_statistics_do_not_depend_on_the_cut(monkeypatch):
    text = ODD_TEXTS[8].encode()
    whole = quality.statistics(text)
    assert len(whole) == quality.STATISTICS == len(quality.statistics(b""))
    real = quality.slices
    monkeypatch.setattr(quality, "slices", lambda data, size: real(data, 1000))
    assert quality.statistics(text)[:15] == pytest.approx(whole[:15]) and quality.statistics(text)[19:23] == pytest.approx(whole[19:23])


def test_isotonic_against_least_squares():
    draw = np.random.default_rng(3)
    for _ in range(30):
        y, w = draw.integers(0, 5, 12).astype(float), draw.integers(1, 4, 12).astype(float)
        xs, ys = quality.isotonic([(i, w[i], y[i] * w[i]) for i in range(12)])
        assert all(a < b for a, b in zip(ys, ys[1:])) and all(a < b for a, b in zip(xs, xs[1:]))
        # the minimax formula of the isotonic fit
        fit = [max(min(np.average(y[a:b + 1], weights=w[a:b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert ys == pytest.approx(sorted(set(np.round(fit, 9))), abs=1e-6)
