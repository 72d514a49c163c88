"""File catalogue and variable dictionary of a folder of survey waves."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import global_rank
from ..operators.staging import join_summary
from ..params import FILE_PATTERN, WHOLE_FOLDERS

# Fixed value: footer entry under which Spark keeps column metadata.
_ROW_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def file_catalog(
    spark: SparkSession, root: str, folder_pattern: str = "^[1-9]", whole_folders=WHOLE_FOLDERS, file_pattern: str = FILE_PATTERN
) -> DataFrame:
    """Files of the wave folders with their size in MiB; contents are not read.

    Folders in ``whole_folders`` keep all files, the others those that match
    ``file_pattern``.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )
    plain = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/"))
    below = F.regexp_extract("path", re.escape(plain) + r"/+([^/]+)/[^/]+$", 1)
    rows = listed.select(below.alias("fld"), "path", (F.col("length") / F.lit(1024.0 * 1024.0)).alias("size"))
    keep = F.col("fld").isin(list(whole_folders)) | F.col("path").rlike(file_pattern)
    return rows.where(F.col("fld").rlike(folder_pattern) & keep)


def rank_files(files: DataFrame, by: str = "fld", size: str = "size", path: str = "path") -> DataFrame:
    """Number of files of each folder and their rank by descending size.

    Counts are joined back and ranks are global positions, so that a folder
    with most of the rows is not gathered in one task.
    """
    counts = files.groupBy(by).agg(F.count(F.lit(1)).alias("fld_files"))
    ranked = global_rank(files.withColumn("_smaller", -F.col(size)), [by], ["_smaller", path], "fld_rank")
    return join_summary(ranked.drop("_smaller"), counts, [by])


def variable_dictionary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per Parquet file and variable with its label.

    The paths are listed by Spark; the footers are read inside tasks, many files
    at a time, and nothing else of the files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                system, inside = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with system.open_input_file(inside) as f:
                    schema = pa.parquet.read_schema(f)
                stored = json.loads((schema.metadata or {}).get(_ROW_SCHEMA, b"{}")).get("fields", [])
                labels = {c["name"]: c["metadata"].get("label", "") for c in stored}
                rows += [(path, name, labels.get(name, "")) for name in schema.names]
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "label"])

    listed = files.load(paths).select("path").repartition(parts)
    return listed.mapInArrow(footers, "path string, name string, label string")
