"""Model scoring on time-aware folds and principal components, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle


def fold_scores(folds: DataFrame, features: Sequence[str], label: str, n_folds: int, keep: Sequence[str] = ("symbol", "ts"), trees: int = 100, rounds: int = 1000, depth: int = 4, seed: int = 7) -> DataFrame:
    """Train a random forest and boosted trees on each fold's training rows and mix their test probabilities.

    The weight of a kind of model is its share of the areas under the curve, summed over the folds' test rows.

    Boosting stops before ``rounds`` when a fifth of the training rows, set aside by hash, gets no better.
    ``folds`` has one row per (row, fold) with ``role``, as ``purged_folds`` makes. Rows with nulls are left out.
    """
    known = settle(folds.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double")))  # read by every fit
    data = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(known)
    judge = BinaryClassificationEvaluator(labelCol="_y", metricName="areaUnderROC")
    names, parts, areas = ("forest", "boosted"), [], {"forest": [], "boosted": []}
    for f in range(n_folds):  # one model of each kind per fold
        train = data.where((F.col("fold") == f) & (F.col("role") == "train")).select("_x", "_y", (F.pmod(F.xxhash64(*keep), F.lit(5)) == 0).alias("_aside"))
        out = data.where((F.col("fold") == f) & (F.col("role") == "test"))
        for name, model in zip(
            names,
            (
                RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed),
                GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="_aside"),
            ),
        ):
            out = model.setProbabilityCol(f"_p_{name}").setRawPredictionCol(f"_r_{name}").setPredictionCol(f"_h_{name}").fit(train).transform(out)
            areas[name].append(judge.setRawPredictionCol(f"_r_{name}").evaluate(out))
        parts.append(out.select(*keep, "fold", label, *[vector_to_array(f"_p_{n}")[1].alias(f"score_{n}") for n in names]))
    total = {n: sum(areas[n]) for n in names}
    weight = {n: total[n] / sum(total.values()) if sum(total.values()) else 0.5 for n in names}
    scores = reduce(DataFrame.unionByName, parts)
    mixed = sum((F.col(f"score_{n}") * weight[n] for n in names), F.lit(0.0))
    return scores.withColumns({"score": mixed, **{f"weight_{n}": F.lit(weight[n]) for n in names}})


def _gram(batches: Iterator[pd.DataFrame], cols: list[str], mean: np.ndarray, scale: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sum of the products of all pairs of standardised columns over a task's rows."""
    total, k = np.zeros((len(cols), len(cols))), len(cols)
    for d in batches:
        z = (d[cols].to_numpy(float) - mean) / scale
        total += z.T @ z
    i, j = np.indices((k, k))
    yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})


@dataclass(frozen=True)
class Components:
    """``loadings[c]`` of component c over ``features``; ``variances`` largest first; ``importances``: summed absolute loadings of the first five."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray

    @property
    def importances(self) -> dict[str, float]:
        total = np.abs(self.loadings[:5]).sum(axis=0)
        return dict(sorted(zip(self.features, total.tolist()), key=lambda x: (-x[1], x[0])))


def components(train: DataFrame, features: Sequence[str], most: int = 20) -> Components:
    """Principal components of the standardised features of ``train``; rows with nulls are left out.

    Columns by columns sums leave each task, so only the number of columns bounds what is held. The
    largest loading of a component (the first of equal ones) is positive. A constant feature has loadings of 0.
    """
    cols = list(features)
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    told = rows.agg(F.count(F.lit(1)), *[f(c) for c in cols for f in (F.avg, F.stddev_samp)]).first()
    n, k = told[0], len(cols)
    if n < 2:
        raise ValueError("components need two rows without nulls")
    mean, scale = np.array(told[1::2], float), np.array(told[2::2], float)
    scale = np.where(scale > 0, scale, np.inf)
    sums = rows.mapInPandas(lambda batches: _gram(batches, cols, mean, scale), "i INT, j INT, s DOUBLE").groupBy("i", "j").agg(F.sum("s").alias("s"))
    gram = np.zeros((k, k))
    for r in sums.collect():  # columns by columns
        gram[r.i, r.j] = r.s
    variances, vectors = np.linalg.eigh(gram / (n - 1))
    order = np.argsort(-variances, kind="stable")[: min(most, k)]
    loadings = vectors[:, order].T
    largest = np.argmax(np.round(np.abs(loadings), 9), axis=1)
    loadings = loadings * np.where(loadings[np.arange(len(loadings)), largest] < 0, -1.0, 1.0)[:, None]
    return Components(cols, mean, scale, loadings, variances[order])


def pca_features(df: DataFrame, features: Sequence[str], train_until, most: int = 20, ts: str = "ts") -> tuple[DataFrame, Components]:
    """Append min(``most``, features) components ``pc_1``, ... fitted on rows before ``train_until``; rows with nulls are left out."""
    found = components(df.where(F.col(ts) < train_until), features, most)
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(found.features, found.mean, found.scale)]
    pcs = {f"pc_{c + 1}": sum((x * float(w) for x, w in zip(z, row)), F.lit(0.0)) for c, row in enumerate(found.loadings)}
    return df.dropna(subset=found.features).withColumns(pcs), found
