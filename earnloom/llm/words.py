"""Small column helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The blanks between words, and a word.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="earnloom-package-"), "earnloom.zip")
    with zipfile.ZipFile(path, "w") as made:
        for folder, _, names in os.walk(os.path.join(top, "earnloom")):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    made.write(file, os.path.relpath(file, top))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; no empty strings."""
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed != "", F.split(trimmed, BLANKS)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words: one more than the blank runs between them."""
    return F.size(words(text)).cast("long")


def uniform(*parts: Column | str) -> Column:
    """A number strictly between 0 and 1 that depends on the parts alone (52 bits of an MD5 digest)."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *texts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def sql_uniform(text: str) -> str:
    """The same number in SQL; ``text`` gives the parts joined by colons."""
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
