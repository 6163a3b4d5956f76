"""Shared storage for intermediate tables and output files, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, fresh_path, shared_dir, stored

__all__ = ["BLANKS", "LOWER", "UPPER", "ascii_lower", "discard", "documents", "fresh_path", "shared_dir", "stored", "stored_ids"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"


def stored_ids(df: DataFrame, name: str) -> DataFrame:
    """As stored, in an eighth of the shuffle's partitions (8 at least): for tables of ids, far smaller than their texts.

    Fewer files are made and read; a store without permissions of its own starts a process for each.
    """
    spread = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return stored(df.coalesce(spread), name)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of one byte a character take the fast path of lower()."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
