"""Profiles of record tables, ground truth and feature tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, rows, nulls, empties, percent): one scan for all columns."""
    counts = [x for c in columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_n"), F.count_if(F.trim(c) == "").alias(f"{c}_e"))]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_n").alias("nulls"), F.col(f"{c}_e").alias("empties")) for c in columns]))
    return one.select("rows", cells.alias("x")).select("x.field", "rows", "x.nulls", "x.empties", (100.0 * F.col("x.nulls") / F.col("rows")).alias("percent"))


def country_by_source(records: DataFrame, sources: list[str]) -> DataFrame:
    """Rows per country and source, 0 where there are none; null countries as ''."""
    wide = records.groupBy(F.coalesce("country", F.lit("")).alias("country")).pivot("source", sources).count()
    return wide.na.fill(0, sources)


def names(records: DataFrame) -> DataFrame:
    """Per source: mean length and words of names, distinct names, names by script."""
    n = F.col("business_name")
    return records.groupBy("source").agg(F.avg(F.length(n)).alias("mean_length"), F.avg(F.size(F.split(F.trim(n), r"\s+"))).alias("mean_words"), F.countDistinct(n).alias("distinct_names"), F.count_if(F.length(n) != F.octet_length(n)).alias("non_ascii"), F.count_if(n.rlike(r"[ऀ-ॿ]")).alias("devanagari"))


def top_values(records: DataFrame, column: str, n: int = 3) -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def addresses(records: DataFrame) -> DataFrame:
    """Per source: mean length of addresses, percent with a digit, percent with the word 'near'."""
    a = F.col("business_address")
    return records.groupBy("source").agg(F.avg(F.length(a)).alias("mean_length"), (100.0 * F.avg(F.coalesce(a.rlike(r"\d"), F.lit(False)).cast("int"))).alias("percent_digit"), (100.0 * F.avg(F.coalesce(a.rlike(r"(?i)\bnear\b"), F.lit(False)).cast("int"))).alias("percent_near"))


def top_names(records: DataFrame, n: int = 3) -> DataFrame:
    """(source, place, business_name, rows): the n most frequent names of each source (ties: the smaller name)."""
    counts = records.where("business_name is not null").groupBy("source", "business_name").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("source").orderBy(F.col("rows").desc(), "business_name")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("source", "place", "business_name", "rows")


def truth_summary(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: sources, singletons and their percent, mean, median and most matches of a source."""
    n = truth.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n"))
    every = spine.select("source1_entity_id").distinct().join(n, "source1_entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("n") == 0).alias("singletons"), (100 * F.avg((F.col("n") == 0).cast("int"))).alias("percent_singletons"), F.avg("n").alias("mean_matches"), F.percentile("n", 0.5).alias("median_matches"), F.max("n").alias("most_matches"))


def truth_sizes(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """(matches, sources): how many sources have how many true matches, 0 included."""
    n = truth.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("matches"))
    every = spine.select("source1_entity_id").distinct().join(n, "source1_entity_id", "left")
    return every.groupBy(F.coalesce("matches", F.lit(0)).alias("matches")).agg(F.count(F.lit(1)).alias("sources"))


def shared_candidates(truth: DataFrame) -> DataFrame:
    """One row: true pairs, distinct candidates, candidates with more than one owner."""
    per = truth.groupBy("candidate_entity_id").agg(F.countDistinct("source1_entity_id").alias("owners"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("owners") > 1).alias("shared"))


def collisions(df: DataFrame, raw: str, normal: str) -> DataFrame:
    """(normal form, raws): normal forms of more than one raw value."""
    return df.groupBy(F.col(normal).alias("normal")).agg(F.countDistinct(raw).alias("raws")).where("raws > 1")


def collision_summary(df: DataFrame, raw: str, normal: str) -> DataFrame:
    """One row: distinct raw values and normal forms, the percent that normalising merges, normal forms of several raw values."""
    per = df.where(F.col(raw).isNotNull()).groupBy(F.col(normal).alias("normal")).agg(F.countDistinct(raw).alias("raws"))
    values = df.agg(F.countDistinct(raw).alias("raw_values"))
    one = per.agg(F.count(F.lit(1)).alias("normal_forms"), F.count_if(F.col("raws") > 1).alias("groups")).crossJoin(F.broadcast(values))
    return one.select("raw_values", "normal_forms", (100.0 * (F.col("raw_values") - F.col("normal_forms")) / F.col("raw_values")).alias("percent_merged"), "groups")


def feature_statistics(features: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing, lowest, highest, mean, deviation): one scan for all columns."""
    kinds = {"missing": lambda c: 100.0 * F.avg(F.col(c).isNull().cast("int")), "lowest": lambda c: F.min(c).cast("double"), "highest": lambda c: F.max(c).cast("double"), "mean": F.avg, "deviation": F.stddev_samp}
    one = features.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in kinds.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}_{k}").alias(k) for k in kinds]) for c in columns])).alias("x")).select("x.*")


def correlated(features: DataFrame, columns: list[str], least: float = 0.85) -> DataFrame:
    """(a, b, r): feature pairs with a Pearson correlation over ``least`` in size; one scan."""
    pairs = list(combinations(columns, 2))
    one = features.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return one.select(cells.alias("x")).select("x.*").where(F.abs("r") > least)
