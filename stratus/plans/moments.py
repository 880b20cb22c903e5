"""Linear models from sufficient statistics.

One pass over the rows sums w * z z' for z = (features, 1, label): per task, then over a
fixed number of combining tasks, so the driver gets a matrix of bounded size, whatever the
rows.  Every regularisation strength is solved from the training sums and its squared error
read off the validation sums; no further pass, no fit per grid point.

The solutions are those of MLlib's ``LinearRegression`` with its defaults (features and
label standardised for the penalty, an intercept that is not penalised, no L1 part).  A
feature without variance gets the coefficient 0; where the sums don't determine the
coefficients (collinear features without a penalty) the shortest solution is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMBINERS = 16


@dataclass
class Linear:
    coefficients: np.ndarray
    intercept: float


def _add_rows():
    def run(batches):
        import numpy as np
        import pyarrow as pa
        sums = {}
        for batch in batches:
            values, labels, weights, folds = (batch.column(i) for i in range(4))
            n = batch.num_rows
            if n == 0:
                continue
            z = np.empty((n, len(values.flatten()) // n + 2))
            z[:, :-2] = values.flatten().to_numpy().reshape(n, -1)
            z[:, -2], z[:, -1] = 1.0, labels.to_numpy(zero_copy_only=False)
            weights, folds = weights.to_numpy(zero_copy_only=False), folds.to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                part = z[folds == fold]
                gram = (part * weights[folds == fold][:, None]).T @ part
                sums[int(fold)] = sums.get(int(fold), 0) + gram
        yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int32()), "gram": pa.array([g.tobytes() for g in sums.values()], pa.binary())})
    return run


def _add_sums():
    def run(batches):
        import numpy as np
        import pyarrow as pa
        sums = {}
        for batch in batches:
            for fold, gram in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[fold] = sums.get(fold, 0) + np.frombuffer(gram)
        yield pa.RecordBatch.from_pydict({"fold": pa.array(list(sums), pa.int32()), "gram": pa.array([g.tobytes() for g in sums.values()], pa.binary())})
    return run


def fold_moments(rows: DataFrame, label: Column, weight: Column, fold: Column, features: str = "features") -> dict[int, np.ndarray]:
    """Per fold the sum of weight * z z', in one pass."""
    picked = rows.select(vector_to_array(features).alias("x"), label.cast("double").alias("y"), weight.cast("double").alias("w"),
                         fold.cast("int").alias("fold"))
    per_task = picked.mapInArrow(_add_rows(), "fold int, gram binary")
    out: dict[int, np.ndarray] = {}
    for r in per_task.repartition(COMBINERS).mapInArrow(_add_sums(), "fold int, gram binary").collect():    # COMBINERS rows a fold at most
        gram = np.frombuffer(bytes(r.gram))
        out[r.fold] = out.get(r.fold, 0) + gram.reshape(int(len(gram) ** 0.5), -1)
    return out


def solve(gram: np.ndarray, reg_param: float) -> Linear:
    """The ridge regression that the sums determine."""
    n = gram[-2, -2]
    mean = gram[-2] / n
    cov = gram / n - np.outer(mean, mean)
    cov = np.delete(np.delete(cov, -2, 0), -2, 1)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    scale, label = std[:-1], std[-1]
    coefficients = np.zeros(len(scale))
    used = scale > 1e-12
    if label > 0 and used.any():
        matrix = cov[:-1, :-1][np.ix_(used, used)] / np.outer(scale[used], scale[used]) + reg_param / label * np.eye(used.sum())
        target = cov[:-1, -1][used] / (scale[used] * label)
        coefficients[used] = np.linalg.lstsq(matrix, target, rcond=1e-12)[0] * label / scale[used]
    return Linear(coefficients, float(mean[-1] - coefficients @ np.delete(mean, -2)[:-1]))


def squared_error(gram: np.ndarray, model: Linear) -> float:
    """Sum of weighted squared errors of ``model`` over the rows of the sums."""
    v = np.concatenate((model.coefficients, [model.intercept, -1.0]))
    return float(max(v @ gram @ v, 0.0))
