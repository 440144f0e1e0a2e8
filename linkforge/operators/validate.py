"""Checks of a result file: its header, its lines in one pass, and the whole as a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkforge.sources.tables import there


def parse(lines: DataFrame) -> DataFrame:
    """(line, source1_entity_id, ids) of lines(value) without the header; ids null where a line has no tab. Blank lines go."""
    parts = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", 2)
    rows = lines.where(F.trim("value") != "")
    return rows.select(F.col("value").alias("line"), F.trim(parts[0]).alias("source1_entity_id"), F.when(F.size(parts) > 1, F.filter(F.split(parts[1], ","), lambda x: x != "")).alias("ids"))


def header_error(line: str | None, expected: str) -> str | None:
    """What is wrong with a header line, if anything."""
    if not line or not line.strip():
        return "the file is empty"
    if "\t" not in line and "," in line:
        return "the header is separated by commas"
    return None if [x.strip().lower() for x in line.split("\t")] == [x.strip().lower() for x in expected.split("\t")] else f"the header is not {', '.join(x.strip() for x in expected.split(chr(9)))}"


def problems(rows: DataFrame, required: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """(rule, offender) of parsed rows.

    Rules: no_tab, duplicate_row, duplicate_id, self_match, bad_prefix; with required(entity_id) also
    missing_source and extra_source; with valid(entity_id) also unknown_id.
    """
    good = rows.where("ids is not null")
    each = good.select("source1_entity_id", F.explode("ids").alias("id"))
    out = [
        rows.where("ids is null").select(F.lit("no_tab").alias("rule"), F.col("line").alias("offender")),
        good.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_row"), "source1_entity_id"),
        good.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.lit("duplicate_id"), "source1_entity_id"),
        each.where(F.col("id").startswith("S1-")).select(F.lit("self_match"), "id"),
        each.where(~F.col("id").rlike("^S[123]-")).select(F.lit("bad_prefix"), "id"),
    ]
    if required is not None:
        need, have = required.select(F.col("entity_id").alias("source1_entity_id")).distinct(), good.select("source1_entity_id").distinct()
        out += [need.join(have, "source1_entity_id", "left_anti").select(F.lit("missing_source"), "source1_entity_id"), have.join(need, "source1_entity_id", "left_anti").select(F.lit("extra_source"), "source1_entity_id")]
    if valid is not None:
        out.append(each.where(F.col("id").rlike("^S[23]-")).join(valid.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti").select(F.lit("unknown_id"), "id"))
    total = out[0]
    for part in out[1:]:
        total = total.union(part)
    return total


def bad_text(path_lines: DataFrame) -> DataFrame:
    """(rule, offender) of lines(value binary) that are not UTF-8: the line's beginning with bad bytes replaced."""
    return path_lines.where(~F.is_valid_utf8(F.col("value").cast("string"))).select(F.lit("not_utf8").alias("rule"), F.substring(F.make_valid_utf8(F.col("value").cast("string")), 1, 80).alias("offender"))


def check_file(spark: SparkSession, path: str, header: str, required: DataFrame | None = None, valid: DataFrame | None = None) -> tuple[int, DataFrame]:
    """(exit code, report) of a result file: 0 and no rows if all is well, else 1 and (rule, total, examples).

    A file that is missing, empty, separated by commas or has another header gives one row of rule
    ``file``, and its lines aren't read; a line that is not UTF-8 breaks rule ``not_utf8``.
    """
    def fatal(what: str) -> tuple[int, DataFrame]:
        return 1, spark.createDataFrame([("file", 1, what)], "rule string, total long, examples string")

    if not there(spark, path):
        return fatal(f"{path} does not exist")
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if wrong := header_error(first[0].value if first else None, header):
        return fatal(wrong)
    rows = parse(lines.where(F.lower(F.trim("value")) != header.strip().lower()))
    out = report(problems(rows, required, valid).unionByName(bad_text(lines)))
    return (1 if out.limit(1).count() else 0), out


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of the match file that the candidate file lacks: a warning, not an error."""
    pairs = [x.where("ids is not null").select("source1_entity_id", F.explode("ids").alias("id")).distinct() for x in (matches, candidates)]
    return pairs[0].join(pairs[1], ["source1_entity_id", "id"], "left_anti")


def report(found: DataFrame, shown: int = 5) -> DataFrame:
    """(rule, total, examples): how often each rule is broken, with the first offenders in order."""
    distinct = found.groupBy("rule", "offender").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy("offender"))
    return distinct.withColumn("place", place).groupBy("rule").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.col("offender")))), ",").alias("examples"))
