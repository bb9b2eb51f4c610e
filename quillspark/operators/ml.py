"""Feature assembly, models and their evaluation with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.stats import shrunk
from quillspark.operators.retail import rmse
from quillspark.operators.stats import leave_one_out


def hash_split(key: Column, share: float, seed: int = 0) -> Column:
    """True for about ``share`` of the keys, the same ones every time."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)


def assemble(df: DataFrame, columns: Sequence[str], default: float = 0.0, out: str = "features") -> DataFrame:
    """One vector of the columns; nulls become ``default``."""
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(default)) for c in columns})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol=out).transform(filled).drop(*[f"_f_{c}" for c in columns])


def standardised(df: DataFrame, column: str = "features") -> DataFrame:
    scaler = StandardScaler(inputCol=column, outputCol="_scaled", withMean=True)
    return scaler.fit(df).transform(df).drop(column).withColumnRenamed("_scaled", column)


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Numbers in alphabetical order from 0."""
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df).withColumn(out, F.col(out).cast("int"))


def boosted(train: DataFrame, test: DataFrame, label: str, rounds: int = 20, depth: int = 3, step: float = 0.15, seed: int = 1) -> DataFrame:
    """``test`` with ``prediction`` of gradient-boosted regression trees over ``features``."""
    model = GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(train)
    return model.transform(test)


def stacked(train: DataFrame, test: DataFrame, key: Column, label: str, content: Sequence[str], rest: Sequence[str], folds: int = 2) -> DataFrame:
    """Boosted trees over ``rest`` and a content-only model's score; for training rows the score is out of fold, so nothing leaks."""
    parts, fold = None, F.pmod(F.xxhash64(key), F.lit(folds))
    content_train = assemble(train, content)
    for k in range(folds):
        one = boosted(content_train.where(fold != k), content_train.where(fold == k), label, rounds=10).withColumnRenamed("prediction", "content_score")
        parts = one if parts is None else parts.unionByName(one)
    scored = boosted(content_train, assemble(test, content), label, rounds=10).withColumnRenamed("prediction", "content_score")
    columns = [*rest, "content_score"]
    return boosted(assemble(parts.drop("features"), columns), assemble(scored.drop("features"), columns), label)


#: What is known of a rating's user and item without the rating itself.
RATING_FEATURES = ("u_mean", "u_sd", "u_n", "i_mean", "i_sd", "i_n")


def rating_features(train: DataFrame, test: DataFrame, user: str, item: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``RATING_FEATURES``: mean, deviation and number of the user's and of the item's training ratings.

    A training row's own rating is left out, and test ratings are never looked at, so no label reaches its features. Users and
    items with few other ratings are drawn towards the overall mean, those with none get it.
    """
    known, asked = train, test
    for key, p in ((user, "u"), (item, "i")):
        known = leave_one_out(known, key, value, shrink=True).withColumnsRenamed({"n": f"{p}_n", "mean": f"{p}_mean", "sd": f"{p}_sd"})
        sums = train.groupBy(key).agg(F.count("*").alias("_c"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        overall = F.broadcast(sums.agg(F.avg("_m").alias("_all"), F.avg("_s").alias("_all_sd")))
        n = F.coalesce("_c", F.lit(0))
        found = [n.alias(f"{p}_n"), shrunk(n, F.col("_m"), F.col("_all")).alias(f"{p}_mean"), shrunk(n, F.col("_s"), F.col("_all_sd")).alias(f"{p}_sd")]
        asked = asked.join(sums, key, "left").join(overall).select(*asked.columns, *found)
    return known, asked


def fan_out(train: DataFrame, test: DataFrame, segment: str, columns: Sequence[str], label: str) -> DataFrame:
    """``segment, n, rmse`` of boosted trees trained for each value of ``segment`` on its rows alone; null segments are left out.

    Only the distinct segments come to the driver; every model's training is spread over the cluster.
    """
    out = None
    for (value,) in sorted(tuple(r) for r in train.select(segment).where(F.col(segment).isNotNull()).distinct().collect()):
        own = F.col(segment) == F.lit(value)
        scored = boosted(assemble(train.where(own), columns), assemble(test.where(own), columns), label)
        row = error(scored, label).select(F.lit(value).alias(segment), "n", "rmse")
        out = row if out is None else out.unionByName(row)
    return out


def save(model, path: str) -> None:
    """A fitted model, or a pipeline of them, under ``path``; what was there is replaced."""
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classifier(kind: str, label: str):
    return {
        "forest": RandomForestClassifier(labelCol=label, numTrees=20, maxDepth=5, seed=1),
        "tree": DecisionTreeClassifier(labelCol=label, impurity="entropy", maxDepth=5, seed=1),
        "logistic": LogisticRegression(labelCol=label, maxIter=50),
        "lasso": LogisticRegression(labelCol=label, maxIter=50, regParam=0.01, elasticNetParam=1.0),
    }[kind]


def confusion(predicted: DataFrame, label: str) -> DataFrame:
    return predicted.groupBy(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


def report(predicted: DataFrame, label: str) -> dict[str, float]:
    """Accuracy and micro and weighted F1."""
    score = lambda m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(predicted)
    return {"accuracy": score("accuracy"), "f1": score("f1")}


def grid_search(train: DataFrame, label: str, depths: Sequence[int], trees: Sequence[int], folds: int = 3):
    """The forest of best F1 over a grid, by cross-validation."""
    forest = RandomForestClassifier(labelCol=label, seed=1)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    return CrossValidator(estimator=Pipeline(stages=[forest]), estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=1).fit(train)


def ols(df: DataFrame, label: str, intercept: bool = False) -> tuple[list[float], list[float]]:
    """Coefficients and t values of least squares over ``features``."""
    model = LinearRegression(labelCol=label, fitIntercept=intercept, solver="normal").fit(df)
    return list(model.coefficients), list(model.summary.tValues)


def probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def error(predicted: DataFrame, label: str) -> DataFrame:
    return predicted.agg(rmse(label, "prediction").alias("rmse"), F.count("*").alias("n"))
