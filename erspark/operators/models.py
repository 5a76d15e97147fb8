"""Matchers: gradient-boosted trees, out-of-fold stacking, calibration, transfer.

Undefined features are null; each gets a fill value and a flag, since trees here have no
missing branch. Folds and the early-stop slice follow the entity, so no entity straddles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Matcher:
    """A fitted model with its input columns."""

    columns: list[str]
    model: PipelineModel
    fills: dict[str, float] = field(default_factory=dict)

    def score(self, rows: DataFrame, out: str = "p") -> DataFrame:
        ready = prepare(rows, self.columns, self.fills)
        scored = self.model.transform(ready)
        return scored.withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)

    def importance(self) -> list[tuple[str, float]]:
        names = self.model.stages[0].getInputCols()
        got = zip(names, self.model.stages[1].featureImportances.toArray().tolist(), strict=True)
        return sorted(got, key=lambda x: (-x[1], x[0]))


def prepare(rows: DataFrame, columns: list[str], fills: dict[str, float]) -> DataFrame:
    """Adds f_* without nulls and m_* flags for columns that have a fill value."""
    made = {f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(fills.get(c, 0.0))) for c in columns}
    made |= {f"m_{c}": F.col(c).isNull().cast("double") for c in columns if c in fills}
    return rows.withColumns(made)


def fit(rows: DataFrame, columns: list[str], label: str = "label", rounds: int = 40, depth: int = 5, step: float = 0.1, min_rows: int = 20, seed: int = 0) -> Matcher:
    """Boosted trees with early stopping on the entities of one hash slice in ten."""
    nulls = rows.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    fills = {c: -1.0 for c in columns if nulls[c]}
    ready = prepare(rows, columns, fills).withColumn("_y", F.col(label).cast("double")).withColumn("_stop", F.pmod(F.xxhash64("qi"), F.lit(10)) == 0)
    names = [f"f_{c}" for c in columns] + [f"m_{c}" for c in fills]
    assembler = VectorAssembler(inputCols=names, outputCol="_x")
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=min_rows, subsamplingRate=0.8, featureSubsetStrategy="0.8", validationIndicatorCol="_stop", seed=seed)
    return Matcher(columns, PipelineModel([assembler, trees.fit(assembler.transform(ready))]), fills)


def out_of_fold(rows: DataFrame, columns: list[str], fold: str = "fold", folds: int = 5, out: str = "p", **params) -> DataFrame:
    """Scores of every row by the model of the other folds."""
    done = None
    for i in range(folds):
        part = fit(rows.filter(F.col(fold) != i), columns, **params).score(rows.filter(F.col(fold) == i), out)
        done = part if done is None else done.unionByName(part)
    return done


def isotonic_out_of_fold(rows: DataFrame, score: str = "p", label: str = "label", fold: str = "fold", folds: int = 5, out: str = "p_cal") -> DataFrame:
    """Scores mapped monotonically to match rates, each fold by the map of the others."""
    done = None
    for i in range(folds):
        train = rows.filter(F.col(fold) != i).select(F.col(score).alias("_s"), F.col(label).cast("double").alias("_y"))
        model = IsotonicRegression(featuresCol="_s", labelCol="_y", predictionCol=out).fit(train)
        part = model.transform(rows.filter(F.col(fold) == i).withColumn("_s", F.col(score))).drop("_s")
        done = part if done is None else done.unionByName(part)
    return done


def transfer(rows: DataFrame, columns: list[str], source: str, target: str, **params) -> DataFrame:
    """Rows of the target country scored by a model of the source country."""
    return fit(rows.filter(F.col("country") == source), columns, **params).score(rows.filter(F.col("country") == target))


def ladder(rows: DataFrame, groups: dict[str, list[str]], **params) -> DataFrame:
    """(step, group, auc) of models on more and more groups of features, on held-out folds 3 and 4."""
    from .metrics import auc

    out, columns = None, []
    for i, (name, more) in enumerate(groups.items()):
        columns = columns + [c for c in more if c in rows.columns]
        scored = fit(rows.filter("fold < 3"), columns, **params).score(rows.filter("fold >= 3"))
        row = auc(scored, "p", "label").select(F.lit(i).alias("step"), F.lit(name).alias("group"), "auc")
        out = row if out is None else out.unionByName(row)
    return out


def leave_one_out(rows: DataFrame, groups: dict[str, list[str]], **params) -> DataFrame:
    """(left_out, auc) of models without one group each."""
    from .metrics import auc

    out = None
    for name in groups:
        columns = [c for g, cs in groups.items() if g != name for c in cs if c in rows.columns]
        scored = fit(rows.filter("fold < 3"), columns, **params).score(rows.filter("fold >= 3"))
        row = auc(scored, "p", "label").select(F.lit(name).alias("left_out"), "auc")
        out = row if out is None else out.unionByName(row)
    return out


def feature_auc(rows: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(feature, auc) of each feature alone: null counts as the median, direction does not matter.

    Rows are unpivoted, so one pass ranks all features.
    """
    from .metrics import auc

    medians = rows.agg(*[F.median(c).alias(c) for c in columns])
    m = medians.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("mid")) for c in columns])))
    long = rows.select(label, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])))
    filled = long.join(F.broadcast(m), "feature").withColumn("v", F.coalesce("v", "mid", F.lit(0.0)))
    got = auc(filled, "v", label, "feature")
    return got.select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))
