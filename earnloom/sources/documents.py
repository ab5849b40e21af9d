"""Pattern tables and nested JSON documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import files

# File names and columns of the three pattern tables.
ALLOCATION_FILE = "host_coverage_pattern_allocation.csv"
FACTOR_FILE = "host_pattern_factor.csv"
PATTERN_FILE = "host_pattern.csv"
ALLOCATION_SCHEMA = "coverage_id long, writing_premium_pattern_id long, pattern_start_date timestamp"
FACTOR_SCHEMA = "pattern_id long, period_frequency string, period int, factor_value double, duration double"
PATTERN_SCHEMA = "pattern_id long, pattern_name string"

# Fields of a configuration document.
CONFIG_SCHEMA = (
    "valuationDate string, precision int, ultimateValues array<struct<type:string,value:double>>, "
    "defaultDuration int, calendar boolean, linear boolean, insuredPeriodStartDate string, factorType string, "
    "endOfPeriod boolean, incurredTimeUnit string, exposedTimeUnit string, "
    "elements array<struct<type:string,initial:double,distribution:double,duration:int,initialDuration:int>>"
)
# Fields of a scenario document.
SCENARIO_SCHEMA = (
    "group string, key string, name string, description string, releasable boolean, "
    "factors array<struct<type:string,distribution:double>>"
)
# Fields of pattern and block documents.
PATTERN_DOCUMENT_SCHEMA = (
    "identifier string, duration int, elements array<struct<distribution:double,startDistribution:double,"
    "weight:double,duration:int,startOffset:double,durationOffset:double,developmentPeriods:int>>"
)
BLOCK_DOCUMENT_SCHEMA = (
    "pattern string, elementNumber int, writenElement int, startPoint double, endPoint double, "
    "proportion double, ultimateValue double, shape string"
)


def read_pattern_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coverage allocations, pattern factors and pattern names, with declared column types.

    Columns are found by name, in any order.
    """
    allocations = files.read_csv_by_name(spark, os.path.join(folder, ALLOCATION_FILE), ALLOCATION_SCHEMA)
    factors = files.read_csv_by_name(spark, os.path.join(folder, FACTOR_FILE), FACTOR_SCHEMA)
    patterns = files.read_csv_by_name(spark, os.path.join(folder, PATTERN_FILE), PATTERN_SCHEMA)
    return (
        allocations.withColumn("pattern_start_date", F.col("pattern_start_date").cast("date")),
        factors.withColumn("duration", F.col("duration").cast("int")),
        patterns,
    )


def shape_configs(raw: DataFrame, identifier: str = "config_id") -> DataFrame:
    """Configuration documents with defaults filled in and columns named as the operators use them."""
    return raw.select(
        identifier,
        F.to_date("insuredPeriodStartDate").alias("start_date"),
        F.to_date("valuationDate").alias("valuation_date"),
        F.coalesce("precision", F.lit(6)).alias("precision"),
        F.coalesce("calendar", F.lit(True)).alias("calendar"),
        F.coalesce("linear", F.lit(False)).alias("linear"),
        F.coalesce("endOfPeriod", F.lit(False)).alias("end_of_period"),
        F.coalesce("defaultDuration", F.lit(0)).alias("default_duration"),
        F.upper("incurredTimeUnit").alias("incurred_unit"),
        F.upper("exposedTimeUnit").alias("exposed_unit"),
        F.col("ultimateValues").alias("ultimates"),
        "elements",
    )


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """One document per file; the file name without its ending is the ``config_id``."""
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "")
    return shape_configs(raw.withColumn("config_id", name))


def read_scenarios(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scenario documents, one per file or one per line; text that is not JSON is kept in ``corrupt``."""
    return (
        spark.read.schema(SCENARIO_SCHEMA + ", corrupt string")
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .json(path)
    )


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").json(path, compression=compression)


def write_patterns(elements: DataFrame, path: str, duration: int = 360) -> None:
    """One JSON line per pattern from aligned element rows."""
    entry = F.struct(
        F.col("element_number").alias("_at"),
        F.col("distribution"),
        F.col("start_distribution").alias("startDistribution"),
        F.col("weight"),
        F.col("duration"),
        F.col("start_offset").alias("startOffset"),
        F.col("duration_offset").alias("durationOffset"),
        F.col("development_periods").alias("developmentPeriods"),
    )
    packed = elements.groupBy(F.col("pattern").cast("string").alias("identifier")).agg(
        F.lit(duration).alias("duration"), F.sort_array(F.collect_list(entry)).alias("_all")
    )
    write_json(packed.select("identifier", "duration", F.transform("_all", lambda e: e.dropFields("_at")).alias("elements")), path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Element rows of pattern documents."""
    rows = spark.read.schema(PATTERN_DOCUMENT_SCHEMA).json(path)
    return rows.select(F.col("identifier").alias("pattern"), F.posexplode("elements").alias("element_number", "_e")).select(
        "pattern",
        "element_number",
        F.coalesce("_e.distribution", F.lit(0.0)).alias("distribution"),
        F.coalesce("_e.startDistribution", F.lit(0.0)).alias("start_distribution"),
        F.coalesce("_e.weight", F.lit(0.0)).alias("weight"),
        F.coalesce("_e.duration", F.lit(0)).alias("duration"),
        F.coalesce("_e.startOffset", F.lit(0.0)).alias("start_offset"),
        F.coalesce("_e.durationOffset", F.lit(0.0)).alias("duration_offset"),
        F.coalesce("_e.developmentPeriods", F.lit(0)).alias("development_periods"),
    )


_BLOCK_NAMES = {
    "pattern": "pattern",
    "element_number": "elementNumber",
    "written_element": "writenElement",
    "start_point": "startPoint",
    "end_point": "endPoint",
    "proportion": "proportion",
    "ultimate_value": "ultimateValue",
    "shape": "shape",
}


def write_blocks(blocks: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """One JSON line per block. A pattern of n elements has n x n of them, so they are compressed.

    A compressed file is read by one task; there are as many files as the frame has partitions.
    """
    rows = blocks.select(*[F.col(ours).alias(theirs) for ours, theirs in _BLOCK_NAMES.items()])
    write_json(rows, path, compression)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(BLOCK_DOCUMENT_SCHEMA).json(path)
    return rows.select(*[F.col(theirs).alias(ours) for ours, theirs in _BLOCK_NAMES.items()])
