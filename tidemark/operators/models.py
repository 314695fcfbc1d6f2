"""Regime clustering and meta-label classification on MLlib."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import REGIME_COLUMNS

UNKNOWN = "unknown"


@dataclass
class RegimeModel:
    pipeline: PipelineModel
    names: dict[int, str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Regime per row; a row with an incomplete feature is unknown."""
        clean = df.dropna(subset=REGIME_COLUMNS)
        rest = df.filter(" OR ".join(f"`{c}` IS NULL" for c in REGIME_COLUMNS))
        names = F.create_map(*[x for k, v in self.names.items() for x in (F.lit(k), F.lit(v))])
        hit = self.pipeline.transform(clean).withColumn("regime", F.coalesce(names[F.col("prediction")], F.lit(UNKNOWN)))
        return hit.select(*df.columns, "regime").unionByName(rest.withColumn("regime", F.lit(UNKNOWN)))


def fit_regimes(features: DataFrame, states: int = 4, seed: int = 13, max_iter: int = 100) -> RegimeModel:
    """Full-covariance Gaussian mixture on standardised features. Clusters are named by where
    their centres sit against the median centre."""
    clean = features.select(*REGIME_COLUMNS).dropna()
    if clean.limit(states * 30).count() < states * 30:
        raise ValueError(f"need at least {states * 30} clean rows to fit regimes")
    assembler = VectorAssembler(inputCols=REGIME_COLUMNS, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(assembler.transform(clean))
    mixture = GaussianMixture(k=states, featuresCol="_x", predictionCol="prediction", seed=seed, maxIter=max_iter)
    model = mixture.fit(scaler.transform(assembler.transform(clean)))
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    centres = [g.mean.toArray() * std + mean for g in model.gaussians]
    vol, eff = median(c[0] for c in centres), median(c[2] for c in centres)
    names = {k: f"{'volatile' if c[0] > vol else 'quiet'}_{'trend' if c[2] > eff else 'range'}" for k, c in enumerate(centres)}
    return RegimeModel(PipelineModel([assembler, scaler, model]), names)


# Exposure scale by regime.
REGIME_SCALAR = {"quiet_trend": 1.3, "volatile_trend": 1.0, "quiet_range": 0.6, "volatile_range": 0.4, UNKNOWN: 1.0}


def regime_scalar(regime: Column) -> Column:
    m = F.create_map(*[x for k, v in REGIME_SCALAR.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[regime], F.lit(REGIME_SCALAR[UNKNOWN]))


@dataclass
class MetaModel:
    """One calibrated classifier per purged fold; the probability is their mean."""

    columns: list[str]
    folds: list[tuple]

    def probability(self, df: DataFrame, out: str = "p") -> DataFrame:
        d = VectorAssembler(inputCols=self.columns, outputCol="_x", handleInvalid="skip").transform(df)
        total = F.lit(0.0)
        for i, (tree, iso) in enumerate(self.folds):
            d = _score(tree, iso, d, f"_p{i}")
            total = total + F.col(f"_p{i}")
        return d.withColumn(out, total / len(self.folds)).select(*df.columns, out)


def _raw_score(tree, d: DataFrame, out: str) -> DataFrame:
    d = tree.transform(d)
    return d.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def _score(tree, iso, d: DataFrame, out: str) -> DataFrame:
    d = _raw_score(tree, d, "_s")
    return iso.transform(d).withColumnRenamed("prediction", out).drop("_s")


def fit_meta(folds: DataFrame, columns: list[str], label: str = "label", weight: str | None = None,
             min_samples: int = 150, max_iter: int = 180, seed: int = 7) -> MetaModel:
    """Boosted trees with isotonic calibration, on purged folds only.

    folds: rows with columns fold, role, t0 and t1, as made by the purged splitters. The test rows
    of a fold see neither step: its trees are fitted on the earlier three quarters of its train
    rows, the calibration on those that start later; what lies across the cut is left out."""
    if not {"fold", "role", "t0", "t1"} <= set(folds.columns):
        raise ValueError("calibration needs purged folds with columns fold, role, t0 and t1")
    d = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(folds)
    d = d.withColumn("_y", F.col(label).cast("double")).withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    seen = d.filter(F.col("role") == "test").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_y").alias("k")).first()
    if seen["n"] < min_samples:
        raise ValueError(f"{seen['n']} samples is below the {min_samples} minimum")
    if seen["k"] < 2:
        raise ValueError("labels are all one class")
    fitted = []
    for (fold,) in folds.select("fold").distinct().orderBy("fold").collect():  # a handful of folds
        part = d.filter((F.col("fold") == fold) & (F.col("role") == "train")).select("t0", "t1", "_x", "_y", "_w")
        cut = part.agg(F.percentile("t0", 0.75)).first()[0]
        tree = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=3, stepSize=0.05, maxIter=max_iter,
                             minInstancesPerNode=30, seed=seed).fit(part.filter(F.col("t1") < cut))
        held = _raw_score(tree, part.filter(F.col("t0") >= cut), "_s")
        iso = IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="_w").fit(held)
        fitted.append((tree, iso))
    return MetaModel(columns, fitted)


def out_of_fold(folds: DataFrame, model: MetaModel) -> DataFrame:
    """Each observation scored by the one fold that did not train on it."""
    ids = [r[0] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    out = None
    for fold, (tree, iso) in zip(ids, model.folds):
        part = folds.filter((F.col("fold") == fold) & (F.col("role") == "test"))
        d = VectorAssembler(inputCols=model.columns, outputCol="_x", handleInvalid="skip").transform(part)
        d = _score(tree, iso, d, "p").select(*folds.columns, "p")
        out = d if out is None else out.unionByName(d)
    return out


def evaluate(scored: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Brier score against the base rate's, area under the curve, and the share kept."""
    y = F.col(label).cast("double")
    auc = BinaryClassificationEvaluator(rawPredictionCol=p, labelCol="_y").evaluate(scored.withColumn("_y", y))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - y, F.lit(2))).alias("brier"),
                      (F.avg(y) * (1 - F.avg(y))).alias("brier_base"),
                      F.avg(F.when(F.col(p) >= 0.5, 1.0).otherwise(0.0)).alias("kept")).withColumn("auc", F.lit(auc))
