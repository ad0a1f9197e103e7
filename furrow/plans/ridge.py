"""Ridge regression from one matrix of moments.

The sums of products of all features and all targets are added up in one pass,
per partition and group, and merged by element. Whatever is then asked of the
fit, for any number of targets, penalties, feature subsets or unions of groups,
needs no further look at the rows: coefficients by the normal equations on
standardised features, errors on a group from its own moments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PENALTY = 0.1


@dataclass
class Linear:
    """One target's model in the features' own scales."""

    names: list[str]
    coefficients: np.ndarray
    intercept: float
    rmse: float


@dataclass
class Moments:
    """Sums of products of (1, features, targets)."""

    names: list[str]
    targets: int
    sums: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.names, self.targets, self.sums + other.sums)

    @property
    def rows(self) -> float:
        return float(self.sums[0, 0])

    def first(self, depth: int) -> Moments:
        """The same of the first ``depth`` features."""
        p = len(self.names)
        keep = [*range(depth + 1), *range(p + 1, p + 1 + self.targets)]
        return Moments(self.names[:depth], self.targets, self.sums[np.ix_(keep, keep)])

    def fit(self, penalty: float = PENALTY) -> list[Linear]:
        """A model for each target: the mean squared error plus ``penalty`` times
        the squared coefficients of the standardised features is least. A
        constant feature has coefficient 0."""
        p, n = len(self.names), max(self.rows, 1.0)
        mean = self.sums[0, 1:] / n
        cov = self.sums[1:, 1:] / n - np.outer(mean, mean)
        var = np.diag(cov)[:p]
        # what is left of a constant's square after the subtraction is rounding
        varies = var > 1e-12 * (mean[:p] ** 2 + 1e-300)
        sd = np.sqrt(np.where(varies, var, 1.0))
        z = np.where(np.outer(varies, varies), cov[:p, :p] / np.outer(sd, sd), 0.0)
        w = np.linalg.solve(z + penalty * np.eye(p), np.where(varies[:, None], cov[:p, p:] / sd[:, None], 0.0))
        w = np.where(varies[:, None], w / sd[:, None], 0.0)
        out = []
        for t in range(self.targets):
            b = mean[p + t] - w[:, t] @ mean[:p]
            out.append(Linear(self.names, w[:, t], float(b), 0.0))
            out[-1].rmse = self.rmse(out[-1], t)
        return out

    def rmse(self, model: Linear, target: int = 0) -> float:
        """Error of a model on the rows behind these moments."""
        side = [*range(len(model.names) + 1), len(self.names) + 1 + target]
        weights = np.concatenate(([model.intercept], model.coefficients, [-1.0]))
        square = weights @ self.sums[np.ix_(side, side)] @ weights
        return float(np.sqrt(max(square, 0.0) / max(self.rows, 1.0)))


def moments(rows: DataFrame, names: list[str], targets: list[str], group: str | None = None) -> dict:
    """group -> Moments of its rows (None -> of all), in one pass.

    What reaches the driver is one number for each pair of columns and group,
    however many rows there are. Rows with a null are left out.
    """
    columns = [F.col(c).cast("double") for c in [*names, *targets]]
    slim = rows.select((F.col(group) if group else F.lit(0)).cast("long").alias("group"), F.array(*columns).alias("x"))
    size = len(columns) + 1

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            values = _matrix(batch.column("x"), size - 1)
            whole = ~np.isnan(values).any(1)
            groups = batch.column("group").to_numpy()[whole]
            values = np.column_stack([np.ones(len(groups)), values[whole]])
            for g in np.unique(groups).tolist():
                own = values[groups == g]
                held[g] = held.get(g, 0) + own.T @ own
        for g, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([sums.ravel().tolist()])], ["group", "sums"])

    parts = slim.mapInArrow(run, "group long, sums array<double>").select("group", F.posexplode("sums").alias("place", "value"))
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("group", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["group"], np.zeros(size * size))[r["place"]] = r["value"]
    out = {g: Moments(list(names), len(targets), s.reshape(size, size)) for g, s in found.items()}
    return out if group else out.get(0, Moments(list(names), len(targets), np.zeros((size, size))))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), width)


def predict(rows: DataFrame, models: list[Linear], keep: list[str]) -> DataFrame:
    """``keep`` and ``predicted``, an array with one value a model."""
    names = models[0].names
    weights = np.stack([m.coefficients for m in models], axis=1)
    intercepts = np.array([m.intercept for m in models])
    slim = rows.select(*keep, F.array(*[F.col(c).cast("double") for c in names]).alias("feature_values"))
    schema = rows.select(*keep).withColumn("predicted", F.array(F.lit(0.0))).schema

    def run(batches):
        for batch in batches:
            values = (_matrix(batch.column("feature_values"), len(names)) @ weights + intercepts).ravel()
            offsets = np.arange(0, len(values) + 1, len(models), dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "predicted"])

    return slim.mapInArrow(run, schema)
