"""Readers and writers: record TSV and CSV, candidate and match lists, Parquet, JSON, models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
#: Cells that a record file means as missing.
MISSING = ("", "NA", "N/A", "NULL", "null", "None", "nan", "NaN", "n/a")


def read_records(spark: SparkSession, path: str, schema: str = RECORD, sep: str = "\t", first: int | None = None, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """A delimited record file, all strings; ``first`` takes that many rows from the beginning of the file."""
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("escape", '"').csv(path)
    if first is not None:
        # The best of each task by place in the file, then the best of those: no sort of the file.
        at = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
        df = at.orderBy("_f", "_b", "_n").limit(first).drop("_f", "_b", "_n")
    return df.select(*[F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) for c in df.columns])


def in_chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with chunk: the rows in stretches of ``size`` values of an integer key. One scan serves all chunks."""
    return df.withColumn("chunk", F.floor(F.col(key) / size))


def there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_either(spark: SparkSession, stem: str, schema: str = RECORD) -> DataFrame:
    """stem.csv if there is one, else stem.tsv; an error names both if neither is."""
    for end, sep in ((".csv", ","), (".tsv", "\t")):
        if there(spark, stem + end):
            return read_records(spark, stem + end, schema, sep)
    raise FileNotFoundError(f"neither {stem}.csv nor {stem}.tsv")


def require(spark: SparkSession, *paths: str) -> None:
    """An error that lists those of the paths that do not exist."""
    missing = [p for p in paths if not there(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed first cells of a TSV's rows after the header, blank lines skipped."""
    lines = spark.read.option("header", True).option("sep", "\t").csv(path)
    return lines.select(F.trim(F.col(lines.columns[0])).alias("entity_id")).where("entity_id <> ''").distinct()


def explode_lists(df: DataFrame, ids: str, one: str = "candidate_entity_id") -> DataFrame:
    """One row per distinct id of a comma list column; empty lists give none."""
    rest = [c for c in df.columns if c != ids]
    return df.select(*rest, F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), ",")).alias(one)).where(F.col(one) != "").distinct()


def roll_up(spine: DataFrame, pairs: DataFrame, ids: str = "matched_entity_ids") -> DataFrame:
    """Every source1_entity_id of spine once, with its candidates in ascending order as a comma list ('' if none)."""
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("candidate_entity_id")), ",").alias(ids))
    every = spine.select("source1_entity_id").distinct()
    return every.join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(ids, F.lit("")).alias(ids))


def write_parquet(df: DataFrame, path: str, rows: int = 0) -> DataFrame:
    """df as Parquet, read back; a file has at most ``rows`` rows, 0 for any number."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header, in a folder; a report is small by nature."""
    df.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def load_model(spark: SparkSession, *paths: str) -> tuple[PipelineModel, list[str]]:
    """The first model there is among the paths, and its feature names in order; an error lists all paths if none is."""
    found = next((p for p in paths if there(spark, f"{p}/features") and there(spark, f"{p}/model")), None)
    if found is None:
        raise FileNotFoundError(", ".join(paths))
    return PipelineModel.load(f"{found}/model"), read_json(spark, f"{found}/features")["features"]


def save_model(spark: SparkSession, model: PipelineModel, features: list[str], path: str) -> None:
    """The model and, beside it, the order of its features."""
    model.write().save(f"{path}/model")
    write_json(spark, {"features": features}, f"{path}/features")


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of unquoted TSV files with a header each, sorted by the first column from file to file; empty cells stay bare."""
    plain = {"sep": "\t", "header": True, "emptyValue": "", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.orderBy(df.columns[0]).write.options(**plain).csv(path)


def write_empty_results(spine: DataFrame, path: str) -> None:
    """The two result files with an empty list for every record."""
    every = spine.select("source1_entity_id").distinct()
    for name, column in (("matching_results", "matched_entity_ids"), ("candidate_pairs", "candidate_entity_ids")):
        write_tsv(every.withColumn(column, F.lit("")), f"{path}/{name}.tsv")


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """Settings or metrics as one JSON line in a folder that any Spark filesystem holds."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
