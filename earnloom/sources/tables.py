"""Catalogue tables: create, checked load, dump and load of a schema, queries by name or with parameters."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import pinned
from . import files

ONLY_SELECT = "only queries that start with SELECT can be extracted"


def create_table(
    spark: SparkSession,
    name: str,
    schema: StructType | str,
    partition_by: Sequence[str] = (),
    path: str | None = None,
    overwrite: bool = False,
    fmt: str = "parquet",
) -> None:
    """An empty table with the given schema; nested and decimal types included. ``fmt`` may name a
    format whose package the cluster provides."""
    writer = spark.createDataFrame([], schema).write.format(fmt).mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def load_parquet_to_table(spark: SparkSession, path: str, table: str) -> None:
    """Append a Parquet file to a table that exists and has the same column names in the same order.

    The whole file is read and written to the shared folder first, so a file that cannot be read leaves the table as it was.
    """
    if not spark.catalog.tableExists(table):
        raise ValueError(f"table {table} does not exist")
    incoming = files.read_parquet(spark, path)
    wanted = spark.table(table).columns
    if incoming.columns != wanted:
        raise ValueError(f"columns {incoming.columns} of {path} do not match {wanted} of {table}")
    pinned(incoming).write.insertInto(table)


def _select_only(query: str) -> str:
    if not query.strip().lower().startswith("select"):
        raise ValueError(ONLY_SELECT)
    return query


def extract_query(spark: SparkSession, query: str, path: str, sep: str = ";") -> None:
    """Result of a SELECT to CSV."""
    files.write_csv(spark.sql(_select_only(query)), path, sep)


def extract_table(spark: SparkSession, table: str, path: str, sep: str = ";") -> None:
    files.write_csv(spark.table(table), path, sep)


def dump_schema(spark: SparkSession, schema: str, folder: str | None = None, sep: str = ";") -> list[str]:
    """Every table of a schema to ``<folder>/<table>.csv``."""
    folder = folder or schema
    names = sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)
    for name in names:
        extract_table(spark, f"{schema}.{name}", os.path.join(folder, f"{name}.csv"), sep)
    return names


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder of any file system the session can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName() for s in listed)


def table_of_file(name: str) -> str:
    """Table name of a dump file: no ending, no leading order number."""
    stem = name.rsplit(".", 1)[0]
    return re.sub(r"^\d[^_]*_", "", stem)


def load_schema(spark: SparkSession, schema: str, folder: str | None = None, truncate: bool = False, sep: str = ";") -> list[str]:
    """CSV files in name order into the tables they are named after, typed by the tables.

    Columns are found by name; a file without one of the table's columns is an error. All files are read and
    written to the shared folder before the first table is touched, so one that cannot be read leaves all
    tables as they were, also with ``truncate``.
    """
    folder = folder or schema
    staged = []
    for entry in _entries(spark, folder):
        if not entry.endswith(".csv"):
            continue
        table = f"{schema}.{table_of_file(entry)}"
        target = spark.table(table)
        rows = files.read_csv_by_name(spark, os.path.join(folder, entry), target.schema, sep=sep)
        staged.append((table, pinned(rows)))
    for table, rows in staged:
        rows.write.insertInto(table, overwrite=truncate)
    return [table for table, _ in staged]


_PARAMETER = re.compile(r"'\{(\w+)\}'|\{(\w+)\}")


def bind_parameters(text: str) -> str:
    """``{name}`` and ``'{name}'`` as bound parameters ``:name``, so values are never spliced into the text."""
    return _PARAMETER.sub(lambda m: f":{m.group(1) or m.group(2)}", text)


def read_named_query(spark: SparkSession, name: str, folder: str = "queries") -> str:
    return files.read_document(spark, os.path.join(folder, name if name.endswith(".sql") else f"{name}.sql"))


def named_query(spark: SparkSession, name: str, folder: str = "queries", parameters: Mapping | None = None) -> DataFrame:
    text = bind_parameters(read_named_query(spark, name, folder))
    return spark.sql(_select_only(text).strip().rstrip(";"), args=dict(parameters or {}))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def prepared_query(spark: SparkSession, query: str, parameters: Sequence) -> DataFrame:
    """Query with ``?`` places; their number must equal the number of parameters."""
    places = query.count("?")
    if places != len(parameters):
        raise ValueError(f"expected {places} parameters, got {len(parameters)}")
    return spark.sql(query, args=list(parameters))


def run_script(spark: SparkSession, text: str) -> int:
    """Run the statements of a script, each ended by a semicolon at the end of a line."""
    statements = [s for s in (p.strip() for p in re.split(r";[ \t]*(?:\n|$)", text)) if s]
    for statement in statements:
        spark.sql(statement)
    return len(statements)
