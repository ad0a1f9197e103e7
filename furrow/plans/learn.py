"""Learned forecasts, their explanation, and configuration selection."""

from __future__ import annotations

from functools import reduce

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow import constants as K
from furrow.operators import aggregates as A
from furrow.operators.features import engineer_features
from furrow.operators.joins import label_features
from furrow.operators.series import SERIES, in_order
from furrow.operators.splits import split_ts_folds, test_size, with_position
from furrow.plans import ridge
from furrow.plans.ridge import Linear
from furrow.session import materialise


def stored_features(prices: DataFrame, announcements: DataFrame | None = None) -> DataFrame:
    """The feature matrix written once to the shared folder."""
    return materialise(engineer_features(prices, announcements))


def direct_targets(features: DataFrame, horizon: int) -> DataFrame:
    """Add ``label``: the price ``horizon`` rows ahead, strictly after the row."""
    ahead = F.lead("modal_price", horizon).over(in_order())
    return features.withColumn("label", ahead)


def linear_score(model: Linear) -> Column:
    """The model as plain column arithmetic."""
    terms = [F.col(n) * float(c) for n, c in zip(model.names, model.coefficients)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(model.intercept)))


def regress_forecast(
    features: DataFrame, horizon: int | list[int], train_share: float = 0.8, fit_crops: list[str] | None = None,
    score_crops: list[str] | None = None, penalty: float = ridge.PENALTY,
) -> tuple[Linear, DataFrame]:
    """Direct regressions pooled over series, one for each horizon, from one
    matrix of moments: (model of the last horizon, scored rows).

    The earliest ``train_share`` of each series trains; scored rows (series,
    horizon, date, actual, predicted, spread, bounds) come after.
    ``fit_crops``/``score_crops`` fit on data-rich crops and score others.
    ``features`` should be a stored table (``stored_features``): fitting and
    scoring are separate jobs that each read it.
    """
    horizons = [horizon] if isinstance(horizon, int) else list(horizon)
    last = max(horizons)
    ahead = {f"ahead_{h}": F.lead("modal_price", h).over(in_order()) for h in horizons}
    rows = with_position(features.withColumns(ahead).filter(F.col(f"ahead_{last}").isNotNull()))
    cut = F.floor(F.col("n") * train_share)
    # training targets end before the first scored row
    train = rows.filter(F.col("pos") < cut - last)
    test = rows.filter(F.col("pos") >= cut)
    if fit_crops is not None:
        train = train.filter(F.col("crop").isin(fit_crops))
    if score_crops is not None:
        test = test.filter(F.col("crop").isin(score_crops))
    models = ridge.moments(train, K.FEATURE_NAMES, list(ahead)).fit(penalty)
    test = test.withColumn("actual", F.array(*[F.col(c).cast("double") for c in ahead]))
    scored = ridge.predict(test, models, [*SERIES, "date", "actual"])
    pairs = F.arrays_zip(F.array(*map(F.lit, horizons)).alias("horizon"), F.col("actual"), F.col("predicted"))
    scored = scored.select(*SERIES, "date", F.explode(pairs).alias("p"))
    scored = scored.select(*SERIES, F.col("p.horizon").alias("horizon"), "date", "p.actual", "p.predicted")
    return models[horizons.index(last)], A.residual_interval(scored, [*SERIES, "horizon"])


def holdout_forecasts(features: DataFrame, prices: DataFrame, horizons: list[int]) -> DataFrame:
    """Direct regressions for the back-test: (series, horizon, date, predicted,
    lower_bound, upper_bound) of every test day with a feature row ``horizon``
    rows before.

    One pooled fit per horizon, all from one pass, on rows whose target lies
    before the first test day of their series; the band is 1.96 times the spread
    of the fit's errors.
    """
    sized = with_position(prices.filter(F.col("modal_price").isNotNull()).select(*SERIES, "date"))
    grid = sized.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    first = grid.filter(F.col("pos") == F.col("n") - test_size(F.col("n"), F.col("horizon"))).select(
        *SERIES, "horizon", F.col("date").alias("_first")
    )
    spec = in_order()
    ahead = [
        F.struct(F.lit(h).alias("horizon"), F.lead("modal_price", h).over(spec).alias("label"), F.lead("date", h).over(spec).alias("target"))
        for h in horizons
    ]
    rows = features.withColumn("_ahead", F.array(*ahead)).withColumn("_a", F.explode("_ahead")).select(
        *SERIES, *[F.col(c) for c in K.FEATURE_NAMES], F.col("_a.horizon").alias("horizon"), F.col("_a.label").alias("label"),
        F.col("_a.target").alias("_target"),
    )
    rows = rows.filter(F.col("label").isNotNull()).join(first, [*SERIES, "horizon"])
    found = ridge.moments(rows.filter(F.col("_target") < F.col("_first")), K.FEATURE_NAMES, ["label"], "horizon")
    models = {h: m.fit()[0] for h, m in found.items()}
    point, width = F.lit(None).cast("double"), F.lit(None).cast("double")
    for h, model in models.items():
        point = F.when(F.col("horizon") == h, linear_score(model)).otherwise(point)
        width = F.when(F.col("horizon") == h, 1.96 * model.rmse).otherwise(width)
    scored = rows.filter((F.col("_target") >= F.col("_first")) & F.col("horizon").isin(list(models)))
    return scored.select(
        *SERIES, "horizon", F.col("_target").alias("date"), point.alias("predicted"),
        (point - width).alias("lower_bound"), (point + width).alias("upper_bound"),
    )


def long_features(features: DataFrame) -> DataFrame:
    """One row per (series, date, feature)."""
    as_double = [F.col(c).cast("double").alias(c) for c in K.FEATURE_NAMES]
    return features.select(*SERIES, "date", *as_double).unpivot(
        [*SERIES, "date"], K.FEATURE_NAMES, "feature", "value"
    )


def coefficient_table(spark: SparkSession, model: Linear) -> DataFrame:
    """The model's 53 coefficients as a table."""
    rows = list(zip(K.FEATURE_NAMES, [float(c) for c in model.coefficients]))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def linear_attribution(
    features: DataFrame, coefficients: DataFrame, background: DataFrame | None = None
) -> DataFrame:
    """Attribution of each feature value against the mean background.

    For a linear model, integrating gradients from the baseline to the row is
    exactly coefficient x (value - baseline).
    """
    base = background if background is not None else features
    means = base.agg(*[F.avg(c).alias(c) for c in K.FEATURE_NAMES]).unpivot(
        [], K.FEATURE_NAMES, "feature", "baseline"
    )
    weights = coefficients.join(means, "feature")
    # 53 fixed rows: the side is bounded by the feature list
    return long_features(features).join(F.broadcast(weights), "feature").withColumn(
        "attribution", F.col("coefficient") * (F.col("value") - F.col("baseline"))
    )


def explanation_rows(
    attributions: DataFrame, keys: list[str], sample_date: str = "date"
) -> DataFrame:
    """Importance, last-step mean value, label and rank of each feature.

    ``attributions``: keys, sample, step date, feature, attribution, value.
    """
    importance = A.attribution_importance(attributions, keys)
    last_values = (
        attributions.groupBy(*keys, "sample", "feature")
        .agg(F.max_by("value", sample_date).alias("_v"))
        .groupBy(*keys, "feature")
        .agg(F.avg("_v").alias("feature_value"))
    )
    joined = importance.join(last_values, [*keys, "feature"])
    return label_features(
        A.ranked(joined, keys, F.col("importance").desc(), F.col("feature"))
    )


def smoothing_folds(
    prices: DataFrame, widths: list[int], k: int = 3, min_side: int = 30
) -> DataFrame:
    """RMSE of moving-average forecasts per series, width and validation fold."""
    spec = in_order()
    known = prices.filter(F.col("modal_price").isNotNull())
    guesses = known.withColumns(
        {f"w{w}": F.avg("modal_price").over(spec.rowsBetween(-w, -1)) for w in widths}
    )
    folds = split_ts_folds(guesses, k, min_side).filter(F.col("side") == "validate")
    long = folds.unpivot(
        [*SERIES, "fold", "modal_price"], [f"w{w}" for w in widths], "config", "guess"
    )
    err = F.col("modal_price") - F.col("guess")
    return long.groupBy(*SERIES, "config", "fold").agg(F.sqrt(F.avg(err * err)).alias("rmse"))


def cv_select(prices: DataFrame, widths: list[int], k: int = 3, min_side: int = 30) -> DataFrame:
    """Best smoothing width per series by mean fold score."""
    scores = A.cv_score(smoothing_folds(prices, widths, k, min_side), [*SERIES, "config"])
    return scores.groupBy(*SERIES).agg(
        F.min_by("config", F.struct("score", "config")).alias("config"),
        F.min("score").alias("score"),
    )


def learned_select(
    features: DataFrame, horizon: int, depths: list[int], penalties: list[float], k: int = 3, min_side: int = 30
) -> DataFrame:
    """Depth (first so many features) and penalty of the learned model by
    expanding folds: depth, penalty, score (mean RMSE of the folds), folds, best.

    Fold f validates on the f-th of the last ``k`` blocks of each series and
    trains on rows whose targets end before it. The rows are read once, into the
    moments of the stretches between the folds' borders; every configuration is
    fitted and scored from sums of those.
    """
    rows = with_position(direct_targets(features, horizon).filter(F.col("label").isNotNull()))
    block = F.floor(F.col("n") / (k + 1))
    rows = rows.withColumn("_block", block).filter((F.col("n") - k * block > min_side) & (block > F.greatest(F.lit(min_side), F.lit(horizon))))
    stretch = F.lit(0)
    for fold in range(k):
        start = F.col("n") - (k - fold) * F.col("_block")
        stretch = stretch + (F.col("pos") >= start - horizon).cast("int") + (F.col("pos") >= start).cast("int")
    found = ridge.moments(rows.withColumn("_stretch", stretch), K.FEATURE_NAMES, ["label"], "_stretch")
    scores = []
    for depth in depths:
        parts = {s: m.first(depth) for s, m in found.items()}
        add = lambda of: reduce(lambda a, b: a + b, [parts[s] for s in of if s in parts])
        for penalty in penalties:
            errors = []
            for fold in range(k):
                # stretch 2f + 1 are the rows before fold f whose targets lie in it
                train, check = range(2 * fold + 1), [s for s in (2 * fold + 2, 2 * fold + 3) if s in parts]
                if check and any(s in parts for s in train):
                    errors.append(add(check).rmse(add(train).fit(penalty)[0]))
            if errors:
                scores.append((depth, float(penalty), float(np.mean(errors)), len(errors)))
    best = min(scores, key=lambda s: (s[2], s[0], s[1]), default=None)
    out = [(*s, s is best) for s in scores]
    return features.sparkSession.createDataFrame(out, "depth int, penalty double, score double, folds int, best boolean")
