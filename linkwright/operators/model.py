"""Gradient-boosted classifier over pair features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.config import DEFAULT, Settings
from linkwright.operators.features import ALL


def _require(df: DataFrame, columns: list[str]) -> None:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing feature columns: {lacking}")


class PairClassifier:
    """P(match) of a pair; classes weighted to equal sums, the boosting stopped early on validation rows."""

    def __init__(self, features: list[str] | None = None, settings: Settings = DEFAULT, **boosting) -> None:
        self.features = features or ALL
        self.params = {**settings.boosting, "seed": settings.seed, **boosting}
        self.model: PipelineModel | None = None

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> PairClassifier:
        """train, val: feature columns and `label`. Rounds end once `val` no longer gains."""
        _require(train, self.features)
        n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            raise ValueError("training needs both matches and others")
        weight = F.when(F.col("label") == 1, sum(n.values()) / (2.0 * n[1])).otherwise(sum(n.values()) / (2.0 * n[0]))
        rows = train.select(*self.features, F.col("label").cast("double").alias("label"), weight.alias("w"), F.lit(False).alias("is_val"))
        gbt = GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", **self.params)
        if val is not None:
            rows = rows.unionByName(val.select(*self.features, F.col("label").cast("double").alias("label"), F.lit(1.0).alias("w"), F.lit(True).alias("is_val")))
            gbt = gbt.setParams(validationIndicatorCol="is_val", validationTol=0.001)
        vectors = VectorAssembler(inputCols=self.features, outputCol="x")
        self.model = PipelineModel([vectors, gbt.fit(vectors.transform(rows))])
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """`df` with `match_proba`."""
        if self.model is None:
            raise RuntimeError("the classifier is not fitted")
        _require(df, self.features)
        out = self.model.transform(df)
        return out.withColumn("match_proba", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")

    def importances(self, df: DataFrame) -> DataFrame:
        """(feature, importance), largest first; gains of impurity, adding up to 1."""
        if self.model is None:
            raise RuntimeError("the classifier is not fitted")
        values = self.model.stages[-1].featureImportances.toArray()
        return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(self.features, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        if self.model is None:
            raise RuntimeError("the classifier is not fitted")
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> PairClassifier:
        model = PipelineModel.load(path)
        out = cls(features=model.stages[0].getInputCols())
        out.model = model
        return out


def auc(scored: DataFrame) -> float:
    """Area under the ROC curve of `match_proba` against `label`."""
    rows = scored.select(F.col("label").cast("double").alias("label"), "match_proba")
    return BinaryClassificationEvaluator(rawPredictionCol="match_proba", labelCol="label").evaluate(rows)
