"""Revenue model on pyspark.ml, and its scores as plain aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.functions import flags, text
from placewise.operators.cells import FEATURES, labelled_cells, mcc_median
from placewise.operators.common import add_rank, grouped_medians, grouped_quantile, order_bucket
from placewise.params import FOLDS, MIN_FULL_YEAR, MIN_SHOPS_PER_CELL, PLACE_TYPES
from placewise.session import checkpointed

# Size and speed of the tree ensemble.
GBT_DEFAULTS = {
    "maxIter": 400,
    "maxDepth": 4,
    "stepSize": 0.03,
    "subsamplingRate": 0.8,
    "minInstancesPerNode": 20,
    "featureSubsetStrategy": "0.8",
    "seed": 0,
}
#: Fixed value: the top part of the rows whose hits are counted starts at this quantile.
TOP_SHARE = 0.8
# A fit passes over its rows thousands of times: few full tasks cost less than many small ones.
ROWS_PER_TASK = 20_000


@dataclass(frozen=True)
class RevenueModel:
    """Fitted trees, the medians that fill missing features, and each category's median.

    Without a row to learn from there are no trees, and every score is NULL.
    """

    trees: PipelineModel | None
    fill: dict[str, float | None]
    scale: dict[int, float]

    def score(self, cells: DataFrame) -> DataFrame:
        rows = _prepare(cells, self.fill, self.scale)
        if self.trees is None:
            scored = rows.withColumn("pred_y", F.lit(None).cast("double"))
        else:
            scored = self.trees.transform(rows).withColumnRenamed("prediction", "pred_y")
        return scored.withColumn("predicted_revenue", flags.unlog_target(F.col("pred_y"), F.col("med"))).drop(
            "_features", *[f"_f_{c}" for c in self.fill]
        )


def _prepare(cells: DataFrame, fill: dict[str, float | None], scale: dict[int, float]) -> DataFrame:
    med = F.lit(None).cast("double")
    for code, value in scale.items():
        med = F.when(F.col("mrch_catg_cd") == code, value).otherwise(med)
    filled = {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double"), F.lit(0.0)) for c, v in fill.items()}
    return cells.withColumns({**filled, "med": med})


def fit_revenue(train: DataFrame, target: str, features: Sequence[str] = FEATURES, **gbt) -> RevenueModel:
    """Boosted trees on ln(target / median of the category)."""
    known = train.where(F.col(target).isNotNull())
    # One row of medians, and one row per category of the model.
    medians = grouped_medians(known.withColumn("_one", F.lit(1)), ["_one"], features).first()
    fill = {c: medians[c] if medians else None for c in features}
    scale = {r["mrch_catg_cd"]: r["med"] for r in mcc_median(known, target).collect()}
    if not scale:  # nothing to learn from
        return RevenueModel(None, fill, scale)
    rows = _prepare(known, fill, scale).where(F.col("med").isNotNull())
    label = flags.log_target(F.col(target).cast("double"), F.col("med"))
    tasks = max(1, -(-known.count() // ROWS_PER_TASK))
    labelled = rows.select(*[f"_f_{c}" for c in features], label.alias("label")).coalesce(tasks)
    stages = [
        VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_features"),
        GBTRegressor(featuresCol="_features", labelCol="label", **{**GBT_DEFAULTS, **gbt}),
    ]
    return RevenueModel(Pipeline(stages=stages).fit(labelled), fill, scale)


def fold_of(df: DataFrame, key: str = "pc5", folds: int = FOLDS) -> DataFrame:
    """Fold number by a hash of the postcode: one postcode, one fold."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("fold|"), F.col(key))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (draw % folds).cast("int"))


def stack_oof(all_scored: DataFrame, oof: DataFrame) -> DataFrame:
    """Full-model scores, replaced by out-of-fold scores where a cell has one."""
    replaced = oof.select("pc5", "mrch_catg_cd", F.col("predicted_revenue").alias("_oof"))
    return (
        all_scored.join(replaced, ["pc5", "mrch_catg_cd"], "left")
        .withColumn("out_of_fold", F.col("_oof").isNotNull())
        .withColumn("predicted_revenue", F.coalesce("_oof", "predicted_revenue"))
        .drop("_oof")
    )


def predict_all(
    cells: DataFrame,
    target: str = "revenue_full_year",
    folds: int = FOLDS,
    min_full_year: int = MIN_FULL_YEAR,
    **gbt,
) -> DataFrame:
    """A prediction for every cell; labelled cells get one from a model that has
    not seen their postcode.  A fit is a series of small jobs and knows nothing
    of the others, so all run side by side."""
    labelled = fold_of(labelled_cells(cells, min_full_year, target), folds=folds)
    seen = [r["fold"] for r in labelled.select("fold").distinct().collect()]  # at most one row per fold
    if not seen:  # nothing to learn from
        return cells.withColumns({"predicted_revenue": F.lit(None).cast("double"), "out_of_fold": F.lit(False)})
    held = sorted(f for f in seen if f is not None)
    if len(held) < 2:  # the rest of a single fold has no rows
        held = []
    spark = cells.sparkSession
    with ThreadPoolExecutor(len(held) + 1) as pool:

        def start(rows: DataFrame):
            return pool.submit(inheritable_thread_target(spark)(lambda: fit_revenue(rows, target, **gbt)))

        whole = start(labelled)
        fits = {fold: start(labelled.where(F.col("fold") != fold)) for fold in held}
        parts = [
            fit.result().score(labelled.where(F.col("fold") == fold)).select("pc5", "mrch_catg_cd", "predicted_revenue")
            for fold, fit in fits.items()
        ]
        full = whole.result().score(cells).drop("pred_y", "med")
    if not parts:
        return full.withColumn("out_of_fold", F.lit(False))
    return stack_oof(full, reduce(DataFrame.unionByName, parts))


def out_of_fold_report(predicted: DataFrame, target: str = "revenue_full_year") -> DataFrame:
    """cells, mape, median_ape of the out-of-fold predictions, and full_model_cells, those of the full model."""
    error = flags.ape(F.col(target).cast("double"), F.col("predicted_revenue"))
    rows = predicted.select("out_of_fold", F.when(F.col("out_of_fold"), error).alias("ape"))
    counts = rows.agg(
        F.count_if("out_of_fold").alias("cells"), F.avg("ape").alias("mape"), F.count_if(~F.col("out_of_fold")).alias("full_model_cells")
    )
    return counts.select("cells", "mape", grouped_quantile(rows, [], "ape").scalar().alias("median_ape"), "full_model_cells")


def heldout_scores(cells: DataFrame, target: str, **gbt) -> DataFrame:
    """Scored test postcodes: y, pred_y, predicted_revenue, revenue_actual beside the cell columns.

    Where no training postcode has a target, the scores are NULL.
    """
    work = cells.where(F.col(target).isNotNull())
    train, test = (work.where(F.col("split") == side) for side in ("train", "test"))
    scored = fit_revenue(train, target, **gbt).score(test)
    return scored.withColumn("y", flags.log_target(F.col(target).cast("double"), F.col("med"))).withColumns(
        {"revenue_actual": F.col(target).cast("double")}
    )


def heldout_predictions(cells: DataFrame, target: str = "revenue_full_year", **gbt) -> DataFrame:
    return heldout_table(heldout_scores(cells, target, **gbt))


def heldout_table(scored: DataFrame) -> DataFrame:
    """``heldout_scores`` as it is shown."""
    actual, predicted = F.col("revenue_actual"), F.col("predicted_revenue")
    return scored.select(
        "pc5", "mrch_catg_cd", "district", "n_shops", "n_full_year",
        actual.alias("actual_revenue"), predicted, flags.ape(actual, predicted).alias("ape"),
    ).orderBy("mrch_catg_cd", "pc5")


def top_quintile_precision(scored: DataFrame, q: float = 0.8) -> DataFrame:
    """Share of the rows predicted in the top part that truly are."""
    cut_y = grouped_quantile(scored, [], "y", q).scalar()
    cut_pred = grouped_quantile(scored, [], "pred_y", q).scalar()
    marked = scored.select("pred_y", (F.col("y") >= cut_y).alias("_is"), (F.col("pred_y") >= cut_pred).alias("_said"))
    hit = F.avg(F.when(F.col("_said"), F.col("_is").cast("double")))
    return marked.agg(F.when(F.max("pred_y") > F.min("pred_y"), hit).alias("value"))


def _placed(rows: DataFrame, measures: list[str]) -> DataFrame:
    """(name, value, n, begin) of every distinct value of the measures: its rows, and how many rows lie below; written.

    All measures are stacked and counted in one shuffle.  Buckets of near values
    then tell where each value starts, so no measure is sorted as a whole.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("value")) for m in measures])).alias("m")
    counts = rows.select(stacked).select("m.*").where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    counts = counts.withColumn("_b", order_bucket(F.col("value")))
    lower = Window.partitionBy("name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("name", "_b").agg(F.sum("n").alias("_bn"))
    starts = buckets.select("name", "_b", F.coalesce(F.sum("_bn").over(lower), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("name", "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["name", "_b"])
    return checkpointed(begun.select("name", "value", "n", (F.col("_start") + F.col("_in")).alias("begin")))


def _quantiles(placed: DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """Exact interpolated quantile of each measure; one row per measure reaches the driver."""
    share = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    totals = placed.groupBy("name").agg(F.sum("n").alias("total")).withColumn("at", (F.col("total") - 1) * share[F.col("name")])

    def value_at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("begin")) & (place < F.col("begin") + F.col("n")), F.col("value")))

    # One row per measure.
    found = placed.join(F.broadcast(totals), "name").groupBy("name", "at").agg(
        value_at(F.floor("at")).alias("low"), value_at(F.ceil("at")).alias("high")
    )
    return {r["name"]: r["low"] + (r["high"] - r["low"]) * (r["at"] - math.floor(r["at"])) for r in found.collect()}


def model_metrics(scored: DataFrame) -> DataFrame:
    """cells, r2, mape, median_ape, spearman, top20_precision of (y, pred_y, revenue, pred_revenue).

    One pass counts the values of all measures; ranks, median and cuts are read
    off those counts, and a second pass over the rows makes every sum.
    """
    rows = scored.select(
        *[F.col(c).cast("double").alias(c) for c in ("y", "pred_y", "revenue", "pred_revenue")]
    ).withColumn("ape", flags.ape(F.col("revenue"), F.col("pred_revenue")))
    placed = _placed(rows, ["y", "pred_y", "ape"])
    cuts = _quantiles(placed, {"y": TOP_SHARE, "pred_y": TOP_SHARE, "ape": 0.5})
    ranked = rows.select("y", "pred_y", "ape")
    for col, name in (("y", "ry"), ("pred_y", "rp")):
        place = F.col("begin") + (F.col("n") + 1) / F.lit(2.0)
        ranked = add_rank(ranked, placed.where(F.col("name") == col).select(F.col("value").alias(col), place.alias(name), "n"), col)
    top = (F.col("y") >= F.lit(cuts.get("y"))).cast("double")
    spread = F.stddev_pop("ry") * F.stddev_pop("rp")
    varied = F.max("pred_y") > F.min("pred_y")
    return ranked.agg(
        F.count("*").alias("cells"),
        (1 - F.try_divide(F.sum(F.pow(F.col("y") - F.col("pred_y"), F.lit(2))), F.var_pop("y") * F.count("y"))).alias("r2"),
        F.avg("ape").alias("mape"),
        F.lit(cuts.get("ape")).cast("double").alias("median_ape"),
        F.when(varied, F.try_divide(F.covar_pop("ry", "rp"), spread)).alias("spearman"),
        F.when(varied, F.avg(F.when(F.col("pred_y") >= F.lit(cuts.get("pred_y")), top))).alias("top20_precision"),
    )


def stack_populations(frames: dict[str, DataFrame]) -> DataFrame:
    stacked = None
    for name, frame in frames.items():
        part = frame.select(F.lit(name).alias("population"), "*")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def evaluate(
    cells: DataFrame,
    min_full_year: int = MIN_FULL_YEAR,
    min_shops: int = MIN_SHOPS_PER_CELL,
    full_year_scores: DataFrame | None = None,
    **gbt,
) -> DataFrame:
    """Held-out scores of two populations of cells.

    ``full_year_scores`` are the ``heldout_scores`` of the first, where they are made already.
    """
    populations = {
        f"full-year shops, at least {min_full_year}": (cells.where(F.col("n_full_year") >= min_full_year), "revenue_full_year", full_year_scores),
        f"all shops, at least {min_shops}": (cells.where(F.col("n_shops") >= min_shops), "revenue", None),
    }
    frames = {}
    for name, (frame, target, done) in populations.items():
        scored = heldout_scores(frame, target, **gbt) if done is None else done
        # Each score reads these rows again: keep them, do not score them again.
        kept = checkpointed(
            scored.select("y", "pred_y", F.col("revenue_actual").alias("revenue"), F.col("predicted_revenue").alias("pred_revenue"))
        )
        frames[name] = model_metrics(kept)
    return stack_populations(frames)


def zip_revenue(predicted: DataFrame) -> DataFrame:
    """zip_code, type, predicted_revenue."""
    kind = F.lit(None).cast("string")
    for code, name in PLACE_TYPES.items():
        kind = F.when(F.col("mrch_catg_cd") == code, name).otherwise(kind)
    return predicted.select(
        text.postcode_dash(F.col("pc5")).alias("zip_code"),
        kind.alias("type"),
        F.round("predicted_revenue", 2).alias("predicted_revenue"),
    ).orderBy("zip_code", "type")
