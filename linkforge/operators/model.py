"""Matchers and the no-match gate: a fixed logistic scorer, boosted trees, a random forest."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.sources.scratch import new_path
from linkforge.sources.tables import write_parquet

#: Weights of the fixed scorer, which needs no training.
WEIGHTS = {"name_char_4gram_jaccard": 6.0, "name_token_jaccard": 2.0, "name_length_ratio": 1.0, "address_char_4gram_jaccard": 3.0, "postal_match": 1.5, "country_match": 0.5}
BIAS = -6.0
#: Rows of a partition in training, and of a file that is stored for it.
TRAIN_ROWS = 50_000
GATE_FEATURES = ["max_prob", "mean_prob", "median_prob", "std_prob", "candidate_count", "high_prob_count", "top1_minus_top2", "top1_minus_mean"]


def fixed_score(features: DataFrame, weights: dict[str, float] = WEIGHTS, bias: float = BIAS) -> DataFrame:
    """features with probability, the logistic of a fixed linear form, at six decimals."""
    z = F.lit(bias)
    for c, w in weights.items():
        z = z + w * F.col(c)
    return features.withColumn("probability", F.round(1 / (1 + F.exp(-z)), 6))


def stored(rows: DataFrame) -> DataFrame:
    """rows as Parquet files in the shared folder, TRAIN_ROWS in a file at most, read back."""
    return write_parquet(rows, new_path(rows.sparkSession, "rows"), TRAIN_ROWS)


def train_matcher(train: DataFrame, features: list[str], trees: int = 100, held_out: str | None = None, seed: int = 42, is_stored: bool = False) -> PipelineModel:
    """Boosted trees on label; with ``held_out``, a boolean column, training stops early on its rows.

    The rows are read several times and stored for that, unless they are. They aren't cached: the trees keep
    the binned rows, residuals and errors in memory, and what cached rows drive out of it goes to disk, uncompressed.
    Every level of every tree is a small job, so few rows stand in few partitions, of TRAIN_ROWS each.
    """
    train = train.select(*features, "label", *([held_out] if held_out else []))
    train = train if is_stored else stored(train)
    train = train.coalesce(-(-train.count() // TRAIN_ROWS) or 1)
    gbt = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    if held_out:
        gbt = gbt.setValidationIndicatorCol(held_out)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), gbt]).fit(train)


def train_second(scored_features: DataFrame, second: DataFrame, features: list[str], trees: int = 150, held_out: str | None = None, seed: int = 42) -> PipelineModel:
    """The hard-negative matcher: boosted trees on the pairs of a second-round set (:func:`candidates.second_round`)."""
    keys = ["source1_entity_id", "candidate_entity_id"]
    return train_matcher(scored_features.join(second.select(*keys).distinct(), keys, "left_semi"), features, trees, held_out, seed)


def train_gate(statistics: DataFrame, seed: int = 42) -> PipelineModel:
    """A forest on is_singleton over the entity statistics, classes weighted to balance."""
    n = statistics.groupBy("is_singleton").agg(F.count(F.lit(1)).alias("n"))
    total = statistics.agg(F.count(F.lit(1)).alias("total"))
    weighted = statistics.join(F.broadcast(n), "is_singleton").crossJoin(F.broadcast(total)).withColumn("w", F.col("total") / (2.0 * F.col("n")))
    forest = RandomForestClassifier(featuresCol="x", labelCol="is_singleton", weightCol="w", numTrees=50, maxDepth=5, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=GATE_FEATURES, outputCol="x"), forest]).fit(weighted)


def score(model: PipelineModel, rows: DataFrame, out: str = "probability") -> DataFrame:
    scored = model.transform(rows)
    return scored.withColumn(out, F.round(vector_to_array("probability")[1], 6)).drop(*[c for c in ("x", "rawPrediction", "prediction", *(["probability"] if out != "probability" else [])) if c in scored.columns])


def importance(model: PipelineModel) -> DataFrame:
    """(feature, importance, family): the first family whose word is in the name."""
    from pyspark.sql import SparkSession

    names, last = model.stages[0].getInputCols(), model.stages[-1]
    families = ("name", "address", "postal", "country", "dense", "missing", "source")
    rows = [(n, float(v), next((f.upper() for f in families if f in n), "OTHER")) for n, v in zip(names, last.featureImportances.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double, family string")
