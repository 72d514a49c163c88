"""Pruned scan of wave files whose column names drift."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import join_summary, stage
from ..params import WAVE_COLUMN_PATTERN, WAVE_COLUMNS

_REAL = {"bmi", "wt_int"}


def pick_columns(columns: list[str], any_of: list[str], matches: str | None) -> dict[str, str]:
    """Lower-case name to file name of the listed columns and of the pattern's family.

    Names are compared without case; two columns that differ only in case are
    an error, since neither could be addressed.
    """
    wanted = {c.lower() for c in any_of}
    family = re.compile(matches, re.IGNORECASE) if matches else None
    found: dict[str, str] = {}
    for c in columns:
        if c.lower() in wanted or (family and family.search(c)):
            if c.lower() in found:
                raise ValueError(f"columns {found[c.lower()]!r} and {c!r} differ only in case")
            found[c.lower()] = c
    return found


def scan_columns(df: DataFrame, any_of: list[str], matches: str | None = None) -> DataFrame:
    """Projection to the picked columns under lower-case names."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in pick_columns(df.columns, any_of, matches).items()])


# Bits of a row id: wave, 18 for the file, 33 for the row in it.
_MAX_FILES = 1 << 18


def _plain(path) -> Column:
    """A path with one slash behind its scheme, as listings and row metadata differ in this."""
    return F.regexp_replace(path, "^([a-zA-Z0-9]+):/+", "$1:/")


def file_numbers(files: DataFrame) -> DataFrame:
    """``fld, path, no``: files of a listing numbered within their wave, by path.

    Only the listing is read, never the data, so the numbers cost nothing per row.
    """
    listed = files.select("fld", _plain(F.col("path")).alias("path")).distinct()
    number = F.row_number().over(Window.partitionBy("fld").orderBy("path")).cast("bigint")
    return listed.withColumn("no", number)


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Paths of the Parquet files below ``paths``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return files.load(paths).select("path")


def scan_wave(spark: SparkSession, paths: str | list[str], fld: str, numbers: DataFrame | None = None) -> DataFrame:
    """Raw rows of one wave with its folder, wave number and a stable row id.

    Only the survey's columns are read. Types are fixed here, because waves
    store the same code as different numbers. ``numbers`` are the wave's files
    as ``file_numbers`` gives them, made from a listing if absent.
    """
    paths = [paths] if isinstance(paths, str) else paths
    df = spark.read.parquet(*paths)
    found = pick_columns(df.columns, WAVE_COLUMNS, WAVE_COLUMN_PATTERN)
    wave = int(fld[:4])
    if numbers is None:
        numbers = file_numbers(listing(spark, paths).withColumn("fld", F.lit(fld)))
    numbers = numbers.where(F.col("fld") == fld).select(F.col("path").alias("_file"), F.col("no").alias("_no"))
    rows = df.select(
        _plain(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.row_index").alias("_index"),
        *[F.col(f"`{c}`").try_cast("double" if n in _REAL else "int").alias(n) for n, c in found.items()],
    )
    rows = join_summary(rows, numbers, ["_file"])
    known = F.col("_no") < _MAX_FILES
    number = F.when(known, F.col("_no")).otherwise(F.raise_error(F.lit(f"{fld}: a file without a number, or more files than row ids allow")).cast("bigint"))
    row_id = F.shiftleft(F.lit(wave).cast("bigint"), 51) + F.shiftleft(number, 33) + F.col("_index")
    return rows.select(
        row_id.alias("row_id"), F.lit(fld).alias("fld"), F.lit(wave).alias("wave"),
        *found, F.lit("wt_int" in found).alias("has_wt_int"),
    )


def scan_folder(spark: SparkSession, files: DataFrame) -> DataFrame:
    """All waves of a listing (``fld, path``) as one raw table.

    Waves are planned one by one, as each has its own columns, and read
    together. Files are numbered once; the lists of paths are what a reader needs
    on the driver anyway.
    """
    numbers = stage(file_numbers(files), "file-numbers")
    listed = numbers.groupBy("fld").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("fld").collect()
    if not listed:
        raise ValueError("no files to scan")
    return union_waves([scan_wave(spark, r["paths"], r["fld"], numbers) for r in listed])


def union_waves(waves: list[DataFrame]) -> DataFrame:
    """All waves as one table; a column a wave lacks is null there."""
    out = waves[0]
    for wave in waves[1:]:
        out = out.unionByName(wave, allowMissingColumns=True)
    return out
