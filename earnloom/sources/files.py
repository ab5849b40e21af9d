"""Files: Parquet, CSV, small documents, conversions between them, and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Overwrite; ``compression`` is the configured codec, none without one."""
    df.write.mode("overwrite").option("compression", compression or "none").parquet(path)


def read_csv(spark: SparkSession, path: str, header: bool = True, infer: bool = True, schema=None, sep: str = ",") -> DataFrame:
    """CSV with a header. With a schema the extra inference job is saved."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_csv_by_name(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",") -> DataFrame:
    """The columns of a schema by their names in the file's header, whatever their order there.

    A column that the header lacks is an error; values that do not fit their type become null.
    """
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    missing = [f.name for f in declared.fields if f.name not in rows.columns]
    if missing:
        raise ValueError(f"{path!r} lacks the columns {missing}")
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in declared.fields])


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_by_extension(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A side input named by a mapping step; anything but .csv and .parquet is an error."""
    if path.endswith(".parquet"):
        return read_parquet(spark, path)
    if path.endswith(".csv"):
        return read_csv(spark, path) if schema is None else read_csv_by_name(spark, path, schema)
    raise ValueError(f"unsupported side input {path!r}: use .csv or .parquet")


def read_document(spark: SparkSession, path: str) -> str:
    """Text of one small settings or mapping file, from any file system Spark can read."""
    return spark.read.text(path, wholetext=True).first()[0]


def csv_to_parquet(spark: SparkSession, source: str, target: str, sep: str = ",", schema=None) -> None:
    write_parquet(read_csv(spark, source, sep=sep, schema=schema), target, "snappy")


def parquet_to_csv(spark: SparkSession, source: str, target: str, sep: str = ";") -> None:
    """A file, a folder or a wildcard of Parquet files to CSV with a header."""
    write_csv(read_parquet(spark, source), target, sep)


def describe(df: DataFrame) -> DataFrame:
    """Position, name and type of every column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def describe_parquet(spark: SparkSession, path: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Column types and the first n rows."""
    df = read_parquet(spark, path)
    return describe(df), df.limit(n)


def factor_listing(factors: DataFrame) -> DataFrame:
    return factors.orderBy("pattern_id", "period_frequency", "period")


def factor_profile(factors: DataFrame) -> DataFrame:
    """Row count per pattern and share code."""
    return factors.groupBy("pattern_id", "period_frequency").agg(F.count(F.lit(1)).alias("count"))
