from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placewise.operators import cells as cell_ops
from placewise.operators import model

GBT = {"maxIter": 3, "minInstancesPerNode": 1, "maxDepth": 2}


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(0)
    rows = []
    for i in range(60):
        for mcc in (5812, 5814):
            x = rng.uniform(1, 10)
            rows.append((f"{30000 + i}", mcc, "d", 1 + i % 9, i % 8, 1000 * x * (1 + mcc % 3), None if i % 11 == 0 else x))
    df = spark.createDataFrame(rows, "pc5 string, mrch_catg_cd int, district string, n_shops int, n_full_year int, revenue double, avg_ticket double")
    rest = {f: F.lit(1.0) for f in cell_ops.FEATURES if f not in df.columns}
    out = df.withColumns(rest).withColumn("revenue_full_year", F.when(F.col("n_full_year") > 0, F.col("revenue")))
    return cell_ops.cell_split(out)


def test_split_keeps_postcodes_whole(cells):
    assert cells.groupBy("pc5").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r.split for r in cells.select("split").distinct().collect()} == {"train", "test"}


def test_predict_all(cells):
    out = model.predict_all(cells, folds=3, min_full_year=5, **GBT)
    rows = out.collect()
    assert len(rows) == 120 and all(r.predicted_revenue > 0 for r in rows)
    for r in rows:
        assert r.out_of_fold == (r.n_full_year >= 5)
    folds = model.fold_of(cells).groupBy("pc5").agg(F.count_distinct("fold").alias("n"))
    assert folds.where("n > 1").count() == 0
    zips = model.zip_revenue(out)
    assert zips.columns == ["zip_code", "type", "predicted_revenue"] and zips.count() == 120
    assert {r.type for r in zips.select("type").distinct().collect()} == {"restaurant", "fast food"}


def test_heldout_and_evaluate(cells):
    held = model.heldout_predictions(cells, "revenue", **GBT)
    tested = cells.where("split = 'test'").count()
    assert held.count() == tested
    r = held.first()
    assert r.ape == pytest.approx(abs(r.actual_revenue - r.predicted_revenue) / r.actual_revenue)
    scores = {r.population: r for r in model.evaluate(cells, 1, **GBT).collect()}
    assert set(scores) == {"full-year shops, at least 1", "all shops, at least 5"}
    assert all(0 <= s.mape and s.r2 <= 1 for s in scores.values())


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=200).round(1)
    p = (y + rng.normal(size=200)).round(1)
    revenue, guess = np.exp(y) * 100, np.exp(p) * 100
    df = spark.createDataFrame(pd.DataFrame({"y": y, "pred_y": p, "revenue": revenue, "pred_revenue": guess}))
    got = model.model_metrics(df).first()
    ape = np.abs(revenue - guess) / revenue
    ranks = pd.Series(y).rank(), pd.Series(p).rank()
    top = p >= np.quantile(p, 0.8)
    assert got.cells == 200
    assert got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.mape == pytest.approx(ape.mean()) and got.median_ape == pytest.approx(np.median(ape))
    assert got.spearman == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert got.top20_precision == pytest.approx((y >= np.quantile(y, 0.8))[top].mean())


def test_metrics_of_constant_predictions(spark):
    df = spark.createDataFrame([(1.0, 2.0, 10.0, 8.0), (3.0, 2.0, 10.0, 8.0)], "y double, pred_y double, revenue double, pred_revenue double")
    got = model.model_metrics(df).first()
    assert got.spearman is None and got.top20_precision is None and got.mape == pytest.approx(0.2)


def test_impute(cells):
    train = cells.where("split = 'train'")
    filled = cell_ops.impute_median(train, cells, ["avg_ticket"])
    want = np.median([r.avg_ticket for r in train.collect() if r.avg_ticket is not None])
    was_null = {r.pc5 for r in cells.where("avg_ticket IS NULL").collect()}
    assert all(r.avg_ticket == pytest.approx(want) for r in filled.collect() if r.pc5 in was_null)


def test_second_population_has_its_own_limit(cells):
    few, many = (model.evaluate(cells, 1, n, **GBT).where("population LIKE 'all%'").first() for n in (2, 9))
    assert (few.population, many.population) == ("all shops, at least 2", "all shops, at least 9")
    assert few.cells > many.cells


def test_out_of_fold_report(spark):
    rows = [(True, 100.0, 80.0), (True, 10.0, 11.0), (True, 4.0, 4.0), (False, None, 5.0)]
    got = model.out_of_fold_report(spark.createDataFrame(rows, "out_of_fold boolean, revenue_full_year double, predicted_revenue double")).first()
    assert (got.cells, got.full_model_cells) == (3, 1)
    assert got.mape == pytest.approx(0.1) and got.median_ape == pytest.approx(0.1)


def test_no_training_rows(cells):
    held = model.heldout_predictions(cells.where("split = 'test'"), "revenue", **GBT).collect()
    assert held and all(r.predicted_revenue is None and r.ape is None and r.actual_revenue is not None for r in held)
    # The second population is empty here.
    scores = {r.population: r for r in model.evaluate(cells, 1, 1000, **GBT).collect()}
    assert scores["all shops, at least 1000"].cells == 0 and scores["full-year shops, at least 1"].cells > 0


def test_fit_without_training_rows(cells):
    other = cells.withColumn("mrch_catg_cd", F.lit(None).cast("int"))
    for train in (cells.where("false"), cells.withColumn("revenue", F.lit(None).cast("double")), other):
        fitted = model.fit_revenue(train, "revenue", **GBT)
        assert fitted.trees is None and not fitted.scale
        rows = fitted.score(cells).collect()
        assert len(rows) == 120 and all(r.med is None and r.pred_y is None and r.predicted_revenue is None for r in rows)
        assert fitted.score(cells.where("false")).count() == 0
    like = model.fit_revenue(cells, "revenue", **GBT).score(cells)
    assert fitted.score(cells).dtypes == like.dtypes


def test_fit_of_few_rows(cells):
    """One, two or three rows, which the draws of a tree may leave out altogether."""
    for n in (1, 2, 3):
        train = cells.where("revenue IS NOT NULL").orderBy("pc5", "mrch_catg_cd").limit(n)
        scored = model.fit_revenue(train, "revenue", maxIter=4, minInstancesPerNode=1).score(train).collect()
        assert len(scored) == n and all(r.predicted_revenue > 0 for r in scored)


def test_predictions_without_categories(cells):
    other = cells.withColumn("mrch_catg_cd", F.lit(None).cast("int"))
    rows = model.predict_all(other, folds=3, min_full_year=5, **GBT).collect()
    assert len(rows) == 120 and all(r.predicted_revenue is None for r in rows)
