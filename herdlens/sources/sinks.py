"""Writers: each table of a result set in its own folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outputs that need two animals.
PAIR_OUTPUTS = frozenset({"pair_features", "first_order", "second_order", "behaviour_summary", "contact", "per_second", "synchrony", "bout_table", "pair_bins_025", "pair_bins_1", "engagement_indices", "engagement"})
#: Tables that belong together, by the set's name.
SETS = {
    "main": ("info", "tracking", "animal_features", "pair_features", "first_order", "second_order", "behaviour_summary", "engagement", "zones", "entropy"),
    "key_metrics": ("metrics", "per_second"),
    "binned": ("bins_025", "pair_bins_025", "engagement_indices", "bins_1", "pair_bins_1"),
    "forest": ("bouts", "report", "confusion", "importance", "class_importance"),
    "earlier": ("metadata", "times", "intervals", "matrix"),
}


#: A table, or what makes it: that is called only if the table is wanted.
Table = DataFrame | Callable[[], DataFrame]


def write_set(name: str, tables: dict[str, Table], base: str, format: str = "csv", wanted: Iterable[str] | None = None, animals: int = 2) -> tuple[str, list[str]]:
    """Writes a set's tables below the first free folder {base}_{name}, empty ones left out: (folder, names)."""
    folder = unique_path(SparkSession.active(), f"{base}_{name}")
    chosen = set(SETS[name]) & (set(wanted) if wanted is not None else set(SETS[name]))
    return folder, write_tables(tables, folder, format, chosen, animals, skip_empty=True)


def write_tables(tables: dict[str, Table], folder: str, format: str = "parquet", wanted: Iterable[str] | None = None, animals: int = 2, mode: str = "errorifexists", skip_empty: bool = False) -> list[str]:
    """Writes the wanted tables (all) and returns their names. What isn't wanted is neither made nor computed.

    With one animal, tables about pairs are left out. CSV has no nested columns: they are written as JSON text.
    """
    names = [n for n in tables if (wanted is None or n in set(wanted)) and (animals > 1 or n not in PAIR_OUTPUTS)]
    written = []
    for n in names:
        df = tables[n] if isinstance(tables[n], DataFrame) else tables[n]()
        if skip_empty and df.isEmpty():
            continue
        written.append(n)
        if format == "csv":
            nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
            df = df.withColumns({c: F.to_json(c) for c in nested})
            df.write.mode(mode).option("header", True).csv(f"{folder}/{n}")
        else:
            df.write.mode(mode).format(format).save(f"{folder}/{n}")
    return written


def session_info(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")


def unique_path(spark: SparkSession, base: str) -> str:
    """base, or base_1, base_2, ...: the first that doesn't exist, in whatever store it is."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(jvm.org.apache.hadoop.fs.Path(base if not n else f"{base}_{n}")):
        n += 1
    return base if not n else f"{base}_{n}"
