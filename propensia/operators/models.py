"""Classifiers, grid search over stratified folds, out-of-fold scores and feature selection.

Fits are Spark ML jobs over an assembled ``features`` vector. Three classifiers Spark ML lacks are
Estimators here: boosted stumps, support vectors with calibrated probabilities, nearest neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasSeed
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, functions as F

from propensia.operators.evaluation import BEST_WEIGHTS, cv_metrics, weighted_best
from propensia.operators.neighbors import knn_join, vote_share
from propensia.operators.stumps import best_split
from propensia.session import shared_path, stage
from propensia.sources.artifacts import ArtifactStore


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the ``features`` vector."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)


def _with_probability(df: DataFrame, p: Column) -> DataFrame:
    """``probability`` vector and ``prediction`` from the probability of class 1."""
    return (
        df.withColumn("_p", p)
        .withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
        .withColumn("prediction", (F.col("_p") > 0.5).cast("double"))
        .drop("_p")
    )


def score(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The kept columns with prediction and the probability of class 1 as a number."""
    out = model.transform(df)
    return out.select(*keep, "prediction", vector_to_array("probability")[1].alias("probability"))


# ---- boosted stumps ----------------------------------------------------------------------

class _Boosting(HasFeaturesCol, HasLabelCol, HasMaxIter):
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of each stump", TypeConverters.toFloat)
    exactSplits = Param(Params._dummy(), "exactSplits", "whether all values are tried as cuts, or binned ones", TypeConverters.toBoolean)


class AdaBoostSamme(Estimator, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Discrete SAMME (Zhu et al. 2009) over decision stumps, two classes.

    A row's weight is recomputed from the few numbers describing the stumps so far, so no round adds
    lineage and a lost executor costs nothing but its cached rows. Stumps cut at Spark's binned values, or with
    ``exactSplits`` at any value (``stumps.best_split``: one sort of the distinct values a round).
    """

    @keyword_only
    def __init__(self, *, maxIter=50, learningRate=1.0, exactSplits=False, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(maxIter=50, learningRate=1.0, exactSplits=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AdaBoostSammeModel:
        label = F.col(self.getLabelCol()).cast("double")
        rows = df.select(F.col(self.getFeaturesCol()).alias("features"), label.alias("label")).persist()
        rate, stumps = self.getOrDefault(self.learningRate), []
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="_w")
        try:
            for _ in range(self.getMaxIter()):
                x = vector_to_array("features")
                weight = F.lit(1.0)
                for s in stumps:
                    weight = weight * F.when(_stump(x, s) == F.col("label"), 1.0).otherwise(math.exp(s[4]))
                weighted = rows.withColumn("_w", weight)
                if self.getOrDefault(self.exactSplits):
                    cut = best_split(weighted, x, F.col("label"), F.col("_w")).first()
                    if cut is None:
                        break
                    found, err = [float(cut.feature), cut.threshold, float(cut.below), float(cut.above)], cut.error
                else:
                    found = _stump_of(tree.fit(weighted))
                    missed = _stump(x, found) != F.col("label")
                    err = weighted.agg(F.sum(F.when(missed, F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
                if err is None or err >= 0.5:
                    break
                if err <= 0:
                    stumps.append([*found, 1.0])
                    break
                stumps.append([*found, rate * math.log((1 - err) / err)])
        finally:
            rows.unpersist()
        if not stumps:  # no stump beats chance: a constant vote for the larger class
            major = df.groupBy(label.alias("l")).count().orderBy(F.desc("count"), "l").first()["l"]
            stumps = [[0.0, math.inf, major, major, 1.0]]
        return AdaBoostSammeModel(self.getFeaturesCol(), stumps)


def _stump_of(tree) -> list[float]:
    """(feature, threshold, vote below or at, vote above) of a depth-one tree."""
    node = tree._call_java("rootNode")
    if tree.depth == 0:
        return [0.0, math.inf, node.prediction(), node.prediction()]
    split = node.split()
    return [float(split.featureIndex()), split.threshold(), node.leftChild().prediction(), node.rightChild().prediction()]


def _stump(x: Column, s: Sequence[float]) -> Column:
    return F.when(F.get(x, F.lit(int(s[0]))) <= F.lit(float(s[1])), F.lit(float(s[2]))).otherwise(F.lit(float(s[3])))


class AdaBoostSammeModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weighted vote of stumps; the probability is the logistic of the normalised vote."""

    stumps = Param(Params._dummy(), "stumps", "flat list of feature, threshold, votes, weight", TypeConverters.toListFloat)

    def __init__(self, featuresCol="features", stumps=()):
        super().__init__()
        self._set(featuresCol=featuresCol, stumps=[float(v) for s in stumps for v in s])

    def rounds(self) -> list[list[float]]:
        """Per round: feature, threshold, vote up to it, vote above, weight of the vote."""
        flat = self.getOrDefault(self.stumps)
        return [flat[i : i + 5] for i in range(0, len(flat), 5)]

    def _transform(self, df: DataFrame) -> DataFrame:
        rounds = self.rounds()
        x = vector_to_array(self.getFeaturesCol())
        vote = F.lit(0.0)
        for s in rounds:
            vote = vote + F.lit(s[4]) * (_stump(x, s) * 2 - 1)
        vote = vote / F.lit(sum(s[4] for s in rounds))
        return _with_probability(df, 1 / (1 + F.exp(-vote)))


# ---- support vectors ---------------------------------------------------------------------

class _Svc(HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, HasSeed):
    kernelFeatures = Param(Params._dummy(), "kernelFeatures", "0: linear; n: n random Fourier features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0: 1 / (features x variance)", TypeConverters.toFloat)


class CalibratedSvc(Estimator, _Svc, DefaultParamsReadable, DefaultParamsWritable):
    """Linear support vectors with Platt probabilities; optionally on an RBF feature map.

    The RBF kernel is approximated by random Fourier features (Rahimi and Recht 2007). Calibration
    is a one-feature logistic fit on margins of rows the margin model did not see.
    """

    @keyword_only
    def __init__(self, *, regParam=0.01, maxIter=100, kernelFeatures=0, gamma=0.0, seed=42, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(regParam=0.01, maxIter=100, kernelFeatures=0, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CalibratedSvcModel:
        label = F.col(self.getLabelCol()).cast("double").alias("label")
        rows = df.select(F.col(self.getFeaturesCol()).alias("features"), label)
        size, gamma = self.getOrDefault(self.kernelFeatures), self.getOrDefault(self.gamma)
        projection = np.zeros((0, 0))
        if size:
            array = vector_to_array("features")
            width = rows.select(F.size(array).alias("n")).first()["n"]
            if not gamma:
                spread = rows.select(F.explode(array).alias("v")).agg(F.var_pop("v")).first()[0]
                gamma = 1.0 / (width * (spread or 1.0))
            projection = fourier_projection(width, size, gamma, self.getSeed())
            rows = rows.withColumn("features", array_to_vector(fourier_features(projection)(array)))
        half = F.pmod(F.xxhash64(vector_to_array("features")), F.lit(2))
        rows = rows.withColumn("_half", half).persist()

        def fit(seen: DataFrame):
            return LinearSVC(regParam=self.getRegParam(), maxIter=self.getMaxIter(), standardization=False).fit(seen)

        def unseen_margins(side: int) -> DataFrame:
            scored = fit(rows.filter(F.col("_half") != side)).transform(rows.filter(F.col("_half") == side))
            return scored.select("label", vector_to_array("rawPrediction")[1].alias("margin"))

        try:
            # many short jobs a fit: the three run beside each other, else they mostly wait for the driver
            with ThreadPoolExecutor(3) as pool:
                whole = pool.submit(fit, rows)
                one, other = pool.map(unseen_margins, (0, 1))
                platt = LogisticRegression(maxIter=self.getMaxIter()).fit(assemble(one.unionByName(other), ["margin"]))
                final = whole.result()
        finally:
            rows.unpersist()
        return CalibratedSvcModel(
            self.getFeaturesCol(), final.coefficients.toArray(), final.intercept, projection,
            float(platt.coefficients[0]), platt.intercept,
        )


def fourier_projection(width: int, size: int, gamma: float, seed: int) -> np.ndarray:
    """(width + 1) x size: normal directions scaled for the kernel, and phases in the last row."""
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(width, size)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, (1, size))])


def fourier_features(projection: np.ndarray):
    """Arrow-batched map x -> sqrt(2/n) cos(xW + b)."""

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        z = np.stack([np.asarray(v, dtype=float) for v in x]) @ projection[:-1] + projection[-1]
        return pd.Series(list(np.sqrt(2.0 / projection.shape[1]) * np.cos(z)))

    return features


class CalibratedSvcModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Margin of a linear model, through a logistic curve."""

    weights = Param(Params._dummy(), "weights", "coefficients of the margin", TypeConverters.toListFloat)
    curve = Param(Params._dummy(), "curve", "margin intercept, logistic slope and intercept", TypeConverters.toListFloat)
    projection = Param(Params._dummy(), "projection", "flat kernel projection, empty when linear", TypeConverters.toListFloat)

    def __init__(self, featuresCol="features", weights=(), intercept=0.0, projection=None, slope=1.0, shift=0.0):
        super().__init__()
        flat = [] if projection is None else [float(v) for v in np.ravel(projection)]
        self._set(featuresCol=featuresCol, weights=[float(w) for w in weights], projection=flat,
                  curve=[float(intercept), float(slope), float(shift)])

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, flat = self.getOrDefault(self.weights), self.getOrDefault(self.projection)
        intercept, slope, shift = self.getOrDefault(self.curve)
        x = vector_to_array(self.getFeaturesCol())
        if flat:
            x = fourier_features(np.reshape(flat, (-1, len(weights))))(x)
        products = F.zip_with(x, F.lit(weights), lambda a, b: a * b)
        margin = F.aggregate(products, F.lit(intercept), lambda acc, v: acc + v)
        return _with_probability(df, 1 / (1 + F.exp(-(F.lit(slope) * margin + F.lit(shift)))))


# ---- nearest neighbours ------------------------------------------------------------------

class _Knn(HasFeaturesCol):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "row key", TypeConverters.toString)


class KnnClassifier(Estimator, _Knn, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Votes of the k nearest training rows through the exact neighbour join."""

    @keyword_only
    def __init__(self, *, k=5, weights="uniform", keyCol="key", featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(k=5, weights="uniform", keyCol="key")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> KnnClassifierModel:
        donors = df.select(
            F.col(self.getOrDefault(self.keyCol)).alias("id"), vector_to_array(self.getFeaturesCol()).alias("vec"),
            F.col(self.getLabelCol()).cast("double").alias("payload"),
        )
        model = KnnClassifierModel(donors)
        return model._set(
            featuresCol=self.getFeaturesCol(), k=self.getOrDefault(self.k),
            weights=self.getOrDefault(self.weights), keyCol=self.getOrDefault(self.keyCol),
        )


class KnnClassifierModel(Model, _Knn, MLWritable, MLReadable):
    """Scoring joins against the training rows, which are stored next to the parameters."""

    def __init__(self, donors: DataFrame | None = None):
        super().__init__()
        self.donors = donors

    def neighbours(self, df: DataFrame) -> DataFrame:
        """The k nearest training rows of every row, see ``knn_join``."""
        queries = df.select(F.col(self.getOrDefault(self.keyCol)).alias("id"), vector_to_array(self.getFeaturesCol()).alias("vec"))
        return knn_join(queries, self.donors, self.getOrDefault(self.k))

    def _transform(self, df: DataFrame) -> DataFrame:
        key = self.getOrDefault(self.keyCol)
        near = self.neighbours(df)
        votes = near.groupBy(F.col("id").alias(key)).agg(vote_share(self.getOrDefault(self.weights)).alias("_vote"))
        return _with_probability(df.join(votes, key), F.col("_vote")).drop("_vote")

    def write(self) -> MLWriter:
        return _KnnWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KnnReader()


class _KnnWriter(MLWriter):
    def __init__(self, model: KnnClassifierModel):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self._model, path, self.sparkSession)
        self._model.donors.write.parquet(f"{path}/donors")


class _KnnReader(MLReader):
    def load(self, path: str) -> KnnClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KnnClassifierModel(self.sparkSession.read.parquet(f"{path}/donors"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


# ---- model list --------------------------------------------------------------------------

@dataclass
class ModelSpec:
    """An estimator, its grid, and optionally its own feature columns."""

    name: str
    estimator: Estimator
    grid: list[dict] = field(default_factory=lambda: [{}])
    features: list[str] | None = None


def ridge_strength(c: float, n: int) -> float:
    """Penalty per row for an inverse penalty ``c`` on the summed loss of n rows."""
    return 1.0 / (c * n)


def _grid(estimator: Estimator, **values: Sequence) -> list[dict]:
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(options))
    return builder.build()


def logistic_l2(n: int, cs: Sequence[float] = (0.01, 0.1, 1, 10), max_iter: int = 100, name: str = "logistic", features=None) -> ModelSpec:
    lr = LogisticRegression(elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return ModelSpec(name, lr, _grid(lr, regParam=[ridge_strength(c, n) for c in cs]), features)


def random_forest(trees=(100, 200, 300), depths=(30, 5, 10), seed: int = 42) -> ModelSpec:
    rf = RandomForestClassifier(seed=seed)
    return ModelSpec("random_forest", rf, _grid(rf, numTrees=trees, maxDepth=depths))


def gradient_boosting(stages=(100, 200, 300), rates=(0.1, 0.01, 0.001), seed: int = 42) -> ModelSpec:
    gbt = GBTClassifier(maxDepth=3, seed=seed, checkpointInterval=10)
    return ModelSpec("gradient_boosting", gbt, _grid(gbt, maxIter=stages, stepSize=rates))


def svm(n: int, cs: Sequence[float] = (0.1, 1, 10), kernel_features: Sequence[int] = (0, 256), max_iter: int = 100) -> ModelSpec:
    svc = CalibratedSvc(maxIter=max_iter)
    return ModelSpec("svm", svc, _grid(svc, regParam=[ridge_strength(c, n) for c in cs], kernelFeatures=kernel_features))


def knn(key: str, ks=(3, 5, 7), weights=("uniform", "distance")) -> ModelSpec:
    est = KnnClassifier(keyCol=key)
    return ModelSpec("knn", est, _grid(est, k=ks, weights=weights))


def decision_tree(depths=(30, 5, 10), min_split=(2, 5, 10), seed: int = 42) -> ModelSpec:
    dt = DecisionTreeClassifier(seed=seed)
    return ModelSpec("decision_tree", dt, _grid(dt, maxDepth=depths, minInstancesPerNode=[max(1, s // 2) for s in min_split]))


def adaboost(rounds: int = 50) -> ModelSpec:
    return ModelSpec("adaboost", AdaBoostSamme(maxIter=rounds))


def model_list(n: int, key: str, baseline: Sequence[str]) -> list[ModelSpec]:
    """All compared models with their full grids; ``n`` is the number of training rows."""
    return [
        logistic_l2(n, name="baseline_logistic", features=list(baseline)),
        logistic_l2(n, name="logistic_features"),
        logistic_l2(n, (0.001, 0.01, 0.1, 1, 10), name="logistic_features_added"),
        random_forest(), gradient_boosting(), svm(n), knn(key), decision_tree(), adaboost(),
    ]


# ---- fitting over folds ------------------------------------------------------------------

@dataclass
class Evaluated:
    """Outcome of one model: refitted best model, its grid, and out-of-fold scores."""

    name: str
    model: Model
    best: dict[str, object]
    grid: list[tuple[dict[str, object], float]]
    oof: DataFrame
    features: list[str] = field(default_factory=list)
    prepares: bool = False  # the model begins with its own feature preparation

    def scored(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The kept columns with the best model's prediction and probability."""
        return score(self.model, df if self.prepares else assemble(df, self.features), keep)


def _named(params: Mapping) -> dict[str, object]:
    return {p.name: v for p, v in params.items()}


def _for_rows(params: Mapping, n: int, total: int) -> dict:
    """A grid point for a fit on ``n`` of ``total`` rows: a penalty per row grows as the rows get fewer."""
    return {p: v * total / n if p.name == "regParam" else v for p, v in params.items()}


def _finished(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _neighbour_scores(estimator: KnnClassifier, grid: Sequence[Mapping], train: DataFrame, test: DataFrame, keep: Sequence[str]):
    """Scores by grid point from a single neighbour join with the largest k."""
    most = max([estimator.getOrDefault(estimator.k), *[p[estimator.k] for p in grid if estimator.k in p]])
    model = estimator.copy({estimator.k: most}).fit(train)
    key = estimator.getOrDefault(estimator.keyCol)
    near = stage(model.neighbours(test), "neighbours")

    def scores(params: Mapping) -> DataFrame:
        point = estimator.copy(params)
        votes = near.filter(F.col("rank") <= point.getOrDefault(point.k)).groupBy(F.col("id").alias(key))
        votes = votes.agg(vote_share(point.getOrDefault(point.weights)).alias("probability"))
        return test.select(*keep).join(votes, key).withColumn("prediction", (F.col("probability") > 0.5).cast("double")).select(*keep, "prediction", "probability")

    return scores


def grid_search_cv(
    df: DataFrame, spec: ModelSpec, key: str, features: Sequence[str], folds: int, fold_col: str = "fold", label: str = "label",
    parallelism: int = 4, preprocess: Estimator | None = None, path: str | None = None,
) -> Evaluated:
    """Best grid point by mean accuracy over the given folds, refitted on all rows.

    Fold by fold: ``preprocess``, if given, is fitted on the other folds and makes the ``features`` vector (else the columns
    are assembled as they are); the rows of the fold are written once, ``parallelism`` points are fitted at a time (of several
    folds, if one has fewer), and a fit's out-of-fold scores are written to ``path`` (a folder of this run if none is given). No fitted model of a fold
    is kept. A fit whose scores are complete is not made again, so a search stopped half way goes on where it was;
    name ``path`` by ``artifacts.fingerprint`` to tie it to data and parameters. Accuracies come from the
    written scores, and the scores of the best point are the result's. ``regParam`` values are meant for all rows and scaled to
    the rows of a fit.
    """
    spark = df.sparkSession
    names, path = list(spec.features or features), path or shared_path(spark, "grid")
    df = df.select(*dict.fromkeys([key, label, fold_col, *names, *(preprocess.getOrDefault("categoricalCols") if preprocess else [])]))
    made = [key, label, fold_col, "features"]
    whole = df if preprocess else stage(assemble(df, names).select(*made), "training", rebalance=True)
    total, place = df.count(), lambda point, fold: f"{path}/point={point}/fold={fold}"
    todo = {fold: [i for i in range(len(spec.grid)) if not _finished(spark, place(i, fold))] for fold in range(folds)}
    todo = {fold: points for fold, points in todo.items() if points}

    def run_fold(fold: int) -> None:
        inside = F.col(fold_col) == fold
        train, test = whole.filter(~inside), whole.filter(inside)
        if preprocess:
            fitted = preprocess.copy().fit(train)
            train = stage(fitted.transform(train).select(*made), "training", rebalance=True)
            test = stage(fitted.transform(test).select(*made), "fold")
        n, keep = train.count(), [key, label]
        if isinstance(spec.estimator, KnnClassifier):
            scores = _neighbour_scores(spec.estimator, spec.grid, train, test, keep)
        else:
            scores = lambda params: score(spec.estimator.copy().fit(train, _for_rows(params, n, total)), test, keep)

        def run(point: int) -> None:
            scores(spec.grid[point]).write.mode("overwrite").parquet(place(point, fold))

        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(run, todo[fold]))

    left, beside = list(todo), max(1, parallelism // max(map(len, todo.values()), default=1))  # few points leave room for more folds at a time
    for at in range(0, len(left), beside):
        with ThreadPoolExecutor(beside) as pool:
            list(pool.map(run_fold, left[at : at + beside]))
    scored = spark.read.option("basePath", path).parquet(*[f"{path}/point={i}" for i in range(len(spec.grid))])
    hits = scored.groupBy("point", "fold").agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("hit"))
    accuracy = {r["point"]: r["accuracy"] for r in hits.groupBy("point").agg(F.avg("hit").alias("accuracy")).collect()}  # a number per point
    points = [(_named(p), accuracy[i]) for i, p in enumerate(spec.grid)]
    best = max(range(len(points)), key=lambda i: (round(points[i][1], 12), -i))
    oof = scored.filter(F.col("point") == best).select(key, label, F.col("fold").cast(df.schema[fold_col].dataType).alias(fold_col), "prediction", "probability")
    model = _refitted(spec, spec.grid[best], whole, preprocess, made, path)
    return Evaluated(spec.name, model, points[best][0], points, oof.withColumn("model", F.lit(spec.name)), names, preprocess is not None)


def _refitted(spec: ModelSpec, params: Mapping, whole: DataFrame, preprocess: Estimator | None, made: Sequence[str], path: str) -> Model:
    """The best point fitted on all rows, kept beside the scores."""

    def fit() -> PipelineModel:
        if preprocess is None:
            return PipelineModel([spec.estimator.fit(whole, params)])
        fitted = preprocess.fit(whole)
        rows = stage(fitted.transform(whole).select(*made), "training", rebalance=True)
        return PipelineModel([fitted, spec.estimator.fit(rows, params)])

    model = ArtifactStore(whole.sparkSession, path).model("best", fit)
    return model if preprocess else model.stages[0]


def oof_predictions(
    df: DataFrame, estimator: Estimator, key: str, features: Sequence[str], folds: int, fold_col: str = "fold", label: str = "label",
    preprocess: Estimator | None = None,
) -> DataFrame:
    """One score per row from a model that did not see the row's fold; ``preprocess`` as in ``grid_search_cv``."""
    made = [key, label, fold_col, "features"]
    rows = df if preprocess else stage(assemble(df, features).select(*made), "training", rebalance=True)
    out = None
    for fold in range(folds):
        inside = F.col(fold_col) == fold
        train, test = rows.filter(~inside), rows.filter(inside)
        if preprocess:
            fitted = preprocess.fit(train)
            train, test = stage(fitted.transform(train).select(*made), "training", rebalance=True), fitted.transform(test)
        part = score(estimator.fit(train), test, [key, label, fold_col])
        out = part if out is None else out.unionByName(part)
    return out


def grid_frame(spark, results: Sequence[Evaluated]) -> DataFrame:
    """(model, params, accuracy, best) of every grid point."""
    rows = [
        (r.name, ", ".join(f"{k}={v}" for k, v in sorted(params.items())), acc, params == r.best)
        for r in results for params, acc in r.grid
    ]
    return spark.createDataFrame(rows, "model string, params string, accuracy double, best boolean")


def benchmark(results: Sequence[Evaluated], label: str = "label") -> DataFrame:
    """Mean metrics over folds, one row per model."""
    scores = results[0].oof
    for r in results[1:]:
        scores = scores.unionByName(r.oof)
    return cv_metrics(scores, label=label)


def pick_best(results: Sequence[Evaluated], weights: Mapping[str, float] = BEST_WEIGHTS) -> Evaluated:
    """The evaluated model with the highest weighted metrics, whatever list it came from."""
    name = weighted_best(benchmark(results), weights).first()["model"]
    return next(r for r in results if r.name == name)


# ---- reduced model -----------------------------------------------------------------------

def lasso_select(df: DataFrame, features: Sequence[str], folds: int, key: str = "key", fold_col: str = "fold", label: str = "label", cs: Sequence[float] | None = None, max_iter: int = 100) -> DataFrame:
    """(feature, coefficient) of the features an L1 logistic fit keeps, strength chosen over folds."""
    if key not in df.columns:  # only names the rows of written scores
        df = df.withColumn(key, F.monotonically_increasing_id())
    n = df.count()
    strengths = np.logspace(-4, 0, 50) if cs is None else cs
    lr = LogisticRegression(elasticNetParam=1.0, standardization=False, maxIter=max_iter, labelCol=label)
    spec = ModelSpec("lasso", lr, _grid(lr, regParam=[ridge_strength(float(c), n) for c in strengths]))
    done = grid_search_cv(df, spec, key, features, folds, fold_col, label)
    kept = [(f, float(c)) for f, c in zip(features, done.model.coefficients.toArray()) if c != 0]
    return df.sparkSession.createDataFrame(kept, "feature string, coefficient double")


def reduced_model(train: DataFrame, features: Sequence[str], label: str = "label", max_iter: int = 100) -> Model:
    """Plain logistic regression on the selected features."""
    n = train.count()
    lr = LogisticRegression(elasticNetParam=0.0, standardization=False, maxIter=max_iter, regParam=ridge_strength(1.0, n), labelCol=label)
    return lr.fit(assemble(train, features))


def optimality_residuals(model, rows: DataFrame, features: Sequence[str], l1: float = 0.0, l2: float = 0.0, label: str = "label") -> DataFrame:
    """(feature, residual): how far a logistic fit is from the minimum of its convex loss, per coefficient; 0 at the minimum.

    The loss is the mean log loss plus l1 |b| + l2 b² / 2 per coefficient, the intercept without penalty. The residual is the
    gradient, with an l1 penalty the least absolute subgradient. Recomputed from the assembled ``rows`` in one
    aggregate, independent of the solver.
    """
    weights, intercept = [float(w) for w in model.coefficients], float(model.intercept)
    x = vector_to_array("features")
    margin = F.aggregate(F.zip_with(x, F.lit(weights), lambda a, b: a * b), F.lit(intercept), lambda acc, v: acc + v)
    error = 1 / (1 + F.exp(-margin)) - F.col(label)
    parts = rows.select(error.alias("e"), x.alias("x")).select(array_to_vector(F.concat(F.array(F.col("e")), F.transform("x", lambda v: v * F.col("e")))).alias("g"))
    gradient = [float(v) for v in parts.agg(Summarizer.mean(F.col("g")).alias("m")).first()["m"]]
    out = [("(intercept)", abs(gradient[0]))]
    for name, g, w in zip(features, gradient[1:], weights):
        g += l2 * w
        out.append((name, abs(g + math.copysign(l1, w)) if w else max(0.0, abs(g) - l1)))
    return rows.sparkSession.createDataFrame(out, "feature string, residual double")


def as_stored(model: Model) -> PipelineModel:
    """A fitted model in the form the artifact store saves."""
    return model if isinstance(model, PipelineModel) else PipelineModel([model])
