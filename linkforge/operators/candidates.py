"""Union of candidate lists with provenance, pruning, pair tables and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["source1_entity_id", "candidate_entity_id"]


def union(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, provenance, score): BOTH, SPARSE or DENSE, and the better score."""
    a = sparse.select(*PAIR, F.lit(1).alias("s"), F.lit(0).alias("d"), "score")
    b = dense.select(*PAIR, F.lit(0).alias("s"), F.lit(1).alias("d"), "score")
    both = a.unionByName(b).groupBy(*PAIR).agg(F.max("s").alias("s"), F.max("d").alias("d"), F.max("score").alias("score"))
    tag = F.when(F.col("s") + F.col("d") == 2, "BOTH").when(F.col("s") == 1, "SPARSE").otherwise("DENSE")
    return both.select(*PAIR, tag.alias("provenance"), "score")


def ranked(candidates: DataFrame) -> DataFrame:
    """candidates with place: BOTH before SPARSE before DENSE, then score, then id."""
    kind = F.when(F.col("provenance") == "BOTH", 0).when(F.col("provenance") == "SPARSE", 1).otherwise(2)
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(PAIR[0]).orderBy(kind, F.col("score").desc(), PAIR[1])))


def prune(candidates: DataFrame, max_k: int = 40) -> DataFrame:
    return ranked(candidates).where(F.col("place") <= max_k).drop("place")


def pair_table(candidates: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """candidates with the name, address, country and postal code of both records, and the candidate's source."""
    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        return df.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_address"), F.col("country").alias(f"{p}_country"), F.col("postal_code").alias(f"{p}_postal"))

    out = candidates.join(side(sources, PAIR[0], "s1"), PAIR[0], "left").join(side(targets, PAIR[1], "cand"), PAIR[1], "left")
    return out.withColumn("candidate_source", F.split_part(PAIR[1], F.lit("-"), F.lit(1)))


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where truth(source1_entity_id, candidate_entity_id) has the pair, else 0."""
    return pairs.join(truth.select(*PAIR).distinct().withColumn("label", F.lit(1)), PAIR, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def split(ids: DataFrame, column: str = "source1_entity_id", share: int = 80) -> DataFrame:
    """ids with is_train: all rows of an id fall on the same side, by its md5."""
    number = F.conv(F.substring(F.md5(F.col(column)), 1, 8), 16, 10).cast("long")
    return ids.withColumn("is_train", number % 100 < share)


def hard_negatives(scored: DataFrame, per_entity: int = 3, least: float = 0.5, cap: int | None = None) -> DataFrame:
    """Wrong pairs with a high probability: at most per_entity of a source, then the cap highest of all."""
    wrong = scored.where((F.col("label") == 0) & (F.col("probability") >= least))
    w = Window.partitionBy(PAIR[0]).orderBy(F.col("probability").desc(), PAIR[1])
    top = wrong.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_entity)
    return top if cap is None else top.orderBy(F.col("probability").desc(), *PAIR).limit(cap)


def second_round(scored: DataFrame, hard: DataFrame, ordinary: int = 50_000) -> DataFrame:
    """All positives, all hard negatives, and ordinary negatives in the order of a hash, as a training set."""
    other = scored.where("label = 0").join(hard.select(*PAIR), PAIR, "left_anti")
    other = other.orderBy(F.md5(F.concat_ws("|", *PAIR)), *PAIR).limit(ordinary)
    columns = [*PAIR, "label", "probability"]
    kinds = ((scored.where("label = 1"), "positive"), (other, "ordinary"), (hard, "hard"))
    parts = [df.select(*columns, F.lit(k).alias("kind")) for df, k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
