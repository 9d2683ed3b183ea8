"""Tree models on the cluster: encoding, fitting, predicting, saving with a check of the features.

Categories become the place of the value among the sorted values seen in training, unseen and null ones a place of their own.
Spark's trees take no nulls, so a null number becomes the training median and a flag beside it says so. Nothing but these
maps and medians (fixed by the vocabularies and the number of features) reaches the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..sources.readers import read_text, write_text

KINDS = {"classes": RandomForestClassificationModel, "binary": GBTClassificationModel, "number": GBTRegressionModel}
#: Values of one category that a model tells apart.
MOST_VALUES = 200


@dataclass
class Boosted:
    """kind: classes (``probability``, an array by class), binary (``probability``, of true) or number (``prediction``)."""

    kind: str
    features: list[str]
    categories: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    maps: dict[str, list[str]] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    extra: dict = field(default_factory=dict)
    model: Model | None = None

    def fit(self, train: DataFrame, target: str | Column, valid: DataFrame | None = None) -> Boosted:
        """valid ends the rounds of boosting where it stops getting better."""
        numbers = [f for f in self.features if f not in self.categories]
        self.maps = {c: [r[0] for r in train.select(F.col(c).cast("string")).distinct().filter(F.col(c).isNotNull()).orderBy(c).limit(MOST_VALUES + 1).collect()] for c in self.categories}
        if many := [c for c, v in self.maps.items() if len(v) > MOST_VALUES]:
            raise ValueError(f"{', '.join(many)}: more than {MOST_VALUES} values")
        middle = train.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(c) for c in numbers]).collect()[0] if numbers else {}
        self.medians = {c: float(middle[c]) if middle[c] is not None else 0.0 for c in numbers}
        rows = self._rows(train, target)
        shared = {"featuresCol": "features", "labelCol": "label", "seed": 0, "maxBins": max(32, *(len(v) + 1 for v in self.maps.values()), 0) if self.maps else 32, **self.params}
        if self.kind == "classes":
            self.model = RandomForestClassifier(**shared).fit(rows)
            return self
        make = GBTClassifier if self.kind == "binary" else GBTRegressor
        if valid is not None:
            rows = rows.withColumn("held", F.lit(False)).union(self._rows(valid, target).withColumn("held", F.lit(True)))
            shared |= {"validationIndicatorCol": "held"}
        self.model = make(**shared).fit(rows)
        return self

    def _rows(self, df: DataFrame, target: str | Column) -> DataFrame:
        label = F.col(target) if isinstance(target, str) else target
        if self.kind == "classes":
            label = E.mapped(label, {c: i for i, c in enumerate(self.classes)})
        return self._encoded(df.withColumn("label", label.cast("double")).filter("label is not null")).select("features", "label")

    def _encoded(self, df: DataFrame) -> DataFrame:
        columns = {}
        for c in self.features:
            if c in self.categories:
                places = {v: i for i, v in enumerate(self.maps[c])}
                known = E.mapped(F.col(c).cast("string"), places) if places else F.lit(None)
                columns[f"_f_{c}"] = F.coalesce(known, F.lit(len(places))).cast("double")
            else:
                columns[f"_f_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
                columns[f"_n_{c}"] = F.col(c).isNull().cast("double")
        return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.withColumns(columns)).drop(*columns)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with ``probability`` or ``prediction``."""
        if self.model is None:
            raise RuntimeError("the model isn't fitted")
        out = self.model.transform(self._encoded(df.drop("probability", "prediction", "rawPrediction", "features")))
        if self.kind == "number":
            return out.drop("features")
        p = vector_to_array("probability")
        if self.kind == "binary":
            return out.withColumn("probability", F.get(p, F.lit(1))).drop("features", "rawPrediction", "prediction")
        filled = F.transform(F.sequence(F.lit(0), F.lit(len(self.classes) - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0)))  # classes never seen come last
        return out.withColumn("probability", filled).drop("features", "rawPrediction", "prediction")

    def importance(self) -> list[tuple[str, float]]:
        """Features by what they gained, the largest first; a number's flag counts with it."""
        names = [n for c in self.features for n in ([c] if c in self.categories else [c, c])]
        total = dict.fromkeys(self.features, 0.0)
        for name, gain in zip(names, self.model.featureImportances.toArray().tolist(), strict=True):
            total[name] += gain
        return sorted(total.items(), key=lambda x: (-x[1], x[0]))

    def save(self, spark: SparkSession, folder: str, metrics: dict | None = None) -> str:
        self.model.write().overwrite().save(f"{folder}/model")
        about = {k: getattr(self, k) for k in ("kind", "features", "categories", "classes", "params", "maps", "medians", "extra")}
        write_text(spark, f"{folder}/meta.json", json.dumps(about, indent=1, sort_keys=True))
        write_text(spark, f"{folder}/metrics.json", json.dumps(metrics or {}, indent=1, sort_keys=True))
        return folder

    @classmethod
    def load(cls, spark: SparkSession, folder: str, features: list[str] | None = None) -> Boosted:
        """Refuses a model whose features aren't those that are asked for: retrain it rather than score with others."""
        about = read_text(spark, f"{folder}/meta.json")
        if about is None:
            raise LookupError(f"no model in {folder}")
        about = json.loads(about)
        if features is not None and about["features"] != features:
            raise ValueError(f"the model in {folder} was trained on other features; retrain it")
        return cls(**about, model=KINDS[about["kind"]].load(f"{folder}/model"))
