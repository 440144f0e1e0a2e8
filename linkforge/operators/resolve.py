"""From pair probabilities to matches: entity statistics, no-match gate, best owner, threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.sources.tables import roll_up

GATE, MATCH = 0.5, 0.86


def entity_statistics(scored: DataFrame) -> DataFrame:
    """One row per source: max, mean, median and deviation of its probabilities, counts, gaps, and whether no label is 1."""
    p = F.col("probability")
    w = Window.partitionBy("source1_entity_id").orderBy(p.desc(), "candidate_entity_id")
    second = F.max(F.when(F.col("place") == 2, p))
    out = scored.withColumn("place", F.row_number().over(w)).groupBy("source1_entity_id").agg(
        F.max(p).alias("max_prob"), F.avg(p).alias("mean_prob"), F.median(p).alias("median_prob"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("std_prob"), F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(p >= 0.5).alias("high_prob_count"), second.alias("second"), (F.max("label") == 0).cast("int").alias("is_singleton"),
    )
    return out.withColumn("top1_minus_top2", F.col("max_prob") - F.coalesce("second", F.lit(0.0))).withColumn("top1_minus_mean", F.col("max_prob") - F.col("mean_prob")).drop("second")


def best_owner(scored: DataFrame) -> DataFrame:
    """scored with uniqueness_decision: true for the source with the highest probability of each candidate (ties: smaller id)."""
    w = Window.partitionBy("candidate_entity_id").orderBy(F.col("probability").desc(), "source1_entity_id")
    return scored.withColumn("uniqueness_decision", F.row_number().over(w) == 1)


def gated(singleton: DataFrame, threshold: float = GATE) -> DataFrame:
    """Sources whose singleton_prob reaches the threshold."""
    return singleton.where(F.col("singleton_prob") >= threshold).select("source1_entity_id").distinct()


def matches(scored: DataFrame, singleton: DataFrame | None, threshold: float = MATCH, gate: float = GATE, unique: bool = True, reassign: bool = False) -> DataFrame:
    """Final pairs: probability at the threshold, source not gated, candidate owned.

    Owners are found among all pairs, so a candidate whose best source is gated is lost; with
    ``reassign`` they are found among pairs that pass the gate and the threshold.
    """
    closed = gated(singleton, gate) if singleton is not None else None

    def passed(df: DataFrame) -> DataFrame:
        df = df.where(F.col("probability") >= threshold)
        return df if closed is None else df.join(closed, "source1_entity_id", "left_anti")

    if not unique:
        return passed(scored)
    owned = best_owner(passed(scored)) if reassign else passed(best_owner(scored))
    return owned.where("uniqueness_decision").drop("uniqueness_decision")


def results(spine: DataFrame, final: DataFrame) -> DataFrame:
    """Every source once with its matches as an ascending comma list."""
    return roll_up(spine, final)


def summary(spine: DataFrame, pairs: DataFrame, final: DataFrame, match: float = MATCH, gate: float = GATE) -> DataFrame:
    """One row: sources, candidate counts (mean, median, p95, p99, max, none), matches by source table, the thresholds."""
    per = spine.select("source1_entity_id").distinct().join(pairs.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n")), "source1_entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = per.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("candidates"), F.avg("n").alias("mean_candidates"), F.percentile("n", 0.5).alias("median_candidates"), F.percentile("n", 0.95).alias("p95_candidates"), F.percentile("n", 0.99).alias("p99_candidates"), F.max("n").alias("max_candidates"), F.count_if(F.col("n") == 0).alias("without_candidates"))
    two = final.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("candidate_entity_id").startswith("S2-")).alias("s2_matches"), F.count_if(F.col("candidate_entity_id").startswith("S3-")).alias("s3_matches"), F.countDistinct("source1_entity_id").alias("matched_sources"))
    return one.crossJoin(two).withColumn("match_threshold", F.lit(match)).withColumn("gate_threshold", F.lit(gate))
