"""Run and fold tables carry every threshold of the settings."""

import random

import pytest

from spanledger.operators import metrics as M, models

THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def _at(rows, t):
    tp, fp, fn = (sum(1 for y, p in rows if (y == a) and ((p >= t) == b)) for a, b in ((1, True), (0, True), (1, False)))
    precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return {"precision": precision, "recall": recall, "f1score": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}


def test_each_threshold_equals_counting(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.choice([0.1, 0.3, 0.4, 0.55, 0.6, 0.69])) for _ in range(200)]
    got = models.run_metrics(spark.createDataFrame(rows, "y int, p double"), thresholds=THRESHOLDS)
    assert list(got) == models.metric_names(THRESHOLDS) and len(got) == 21
    for t in THRESHOLDS:
        for m, v in _at(rows, t).items():
            assert got[f"{m}_thr={t}"] == pytest.approx(v)
    # No score reaches 0.7: undefined is 0. The plain columns are those at 0.5.
    assert got["precision_thr=0.7"] == 0 and all(got[m] == got[f"{m}_thr=0.5"] for m in models.AT_THRESHOLD)
    # Another threshold for the plain columns needs not be among the others.
    assert models.run_metrics(spark.createDataFrame(rows, "y int, p double"), threshold=0.58)["recall"] == pytest.approx(_at(rows, 0.58)["recall"])


def test_fold_tables_and_their_summary(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, x := rng.gauss(0, 1), int(x + rng.gauss(0, 1) > 0)) for i in range(300)], "id long, x double, y int")
    folds = models.kfold_cv(df, "id", 3, kind="logreg", columns=["x"], label="y", scaled=["x"], thresholds=THRESHOLDS, maxIter=5)
    assert folds.columns == ["fold", *models.metric_names(THRESHOLDS)]
    rows = folds.collect()
    assert all(a[f"recall_thr={s}"] >= a[f"recall_thr={t}"] for a in rows for s, t in zip(THRESHOLDS, THRESHOLDS[1:]))
    summary = {r["metric"]: r["mean"] for r in M.fold_summary(folds, models.metric_names(THRESHOLDS)).collect()}
    assert len(summary) == 21 and summary["f1score_thr=0.4"] == pytest.approx(sum(r["f1score_thr=0.4"] for r in rows) / 3)
