"""Feature scaling, k-means and the choice of k, shared by customers and products."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from retail_insight.operators.k_sweep import CentreModel, sweep
from retail_insight.operators.sampling import SEED

# What a model that cannot be fitted or scored raises.
MODEL_ERRORS = (PySparkException, Py4JJavaError)

ROWS_PER_TASK = 50_000
SCORES = StructType([StructField("k", IntegerType()), StructField("silhouette", DoubleType())])


def features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``features_raw``, the vector of the given columns; nulls are an error."""
    return VectorAssembler(inputCols=list(columns), outputCol="features_raw").transform(df)


def fit_scaler(df: DataFrame, columns: Sequence[str], with_mean: bool) -> StandardScalerModel:
    """Sample deviation (and mean) of each column."""
    return StandardScaler(
        inputCol="features_raw", outputCol="features", withStd=True, withMean=with_mean
    ).fit(features(df, columns))


def scale_features(df: DataFrame, columns: Sequence[str], with_mean: bool) -> DataFrame:
    """Add ``features``, scaled by the sample deviation; a constant column gives 0."""
    return fit_scaler(df, columns, with_mean).transform(features(df, columns))


def fit_kmeans(scaled: DataFrame, k: int, seed: int = SEED) -> KMeansModel:
    """Fit ``k`` clusters; fewer distinct rows than ``k`` give fewer clusters.

    The block solver fails in that case, so the row solver is asked for.
    """
    return KMeans(featuresCol="features", k=k, seed=seed, solver="row").fit(scaled)


def silhouette(assigned: DataFrame) -> float:
    """Mean squared-Euclidean silhouette; fails when only one cluster is in use."""
    return ClusteringEvaluator(featuresCol="features").evaluate(assigned)


def training_rows(df: DataFrame, key: str, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows in a layout that depends on ``key`` and the task size alone, cached.

    Random initialisation draws by position, so equal data in another layout
    would give other clusters.
    """
    parts = max(1, math.ceil(rows / rows_per_task))
    return df.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Choice:
    """The chosen k with its score and model, and the score and model of every k tried."""

    k: int
    score: float | None
    model: KMeansModel | CentreModel
    tried: list[tuple[int, float | None]]
    models: dict[int, CentreModel] = field(default_factory=dict)

    def scores(self, like: DataFrame) -> DataFrame:
        """Score table ``k``, ``silhouette``."""
        return like.sparkSession.createDataFrame(self.tried, SCORES)


def best_k(tried: Sequence[tuple[int, float | None]]) -> int:
    """First k with the highest score; when none is a number, the first k."""
    known = [(k, s) for k, s in tried if s is not None and not math.isnan(s)]
    if not known:
        return tried[0][0]
    top = max(s for _, s in known)
    return next(k for k, s in known if s == top)


def select_k(
    scaled: DataFrame, ks: Sequence[int], on_error: float | None = None, seed: int = SEED
) -> Choice:
    """Fit every k in the same passes and keep the one with the highest silhouette.

    ``on_error`` is the score of a k whose silhouette cannot be computed; by
    default it has none, and any k with a score is preferred.
    """
    if not ks:
        raise ValueError("no k to try")
    models, _ = sweep(scaled, ks, seed)
    tried = [(k, on_error if models[k].score is None else models[k].score) for k in ks]
    k = best_k(tried)
    return Choice(k, dict(tried)[k], models[k], tried, models)
