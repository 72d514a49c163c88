"""Parallel conversion of Stata files, one file per task."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_CHUNK = 100_000


def read_stata(spark: SparkSession, paths: str, schema: StructType) -> DataFrame:
    """Rows of Stata files as codes, columns matched to ``schema`` by name in lower case, absent ones null.

    ``schema`` may include ``path`` for the source file.
    """
    names = schema.fieldNames()

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                with pd.read_stata(io.BytesIO(content), convert_categoricals=False, chunksize=_CHUNK) as reader:
                    for chunk in reader:
                        chunk.columns = chunk.columns.str.lower()
                        if chunk.columns.has_duplicates:
                            raise ValueError(f"{path}: columns differ in case only")
                        chunk["path"] = path
                        yield chunk.reindex(columns=names)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(convert, schema)


def stata_dictionary(spark: SparkSession, paths: str) -> DataFrame:
    """One row per Stata file and variable with its label."""

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                with pd.read_stata(io.BytesIO(content), iterator=True) as reader:
                    found = reader.variable_labels()
                yield pd.DataFrame({"path": path, "name": list(found), "label": list(found.values())})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(labels, "path string, name string, label string")


def stata_value_labels(spark: SparkSession, paths: str) -> DataFrame:
    """Value labels as a lookup: ``path, name, code, label`` for every labelled variable of every file."""

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                with pd.read_stata(io.BytesIO(content), iterator=True, convert_categoricals=False) as reader:
                    reader.read(1)
                    sets, names = reader.value_labels(), reader.variable_labels()
                rows = [(path, name.lower(), int(code), str(text)) for name in names for code, text in sets.get(name, {}).items()]
                yield pd.DataFrame(rows, columns=["path", "name", "code", "label"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(labels, "path string, name string, code int, label string")


def ingest_stata(spark: SparkSession, paths: str, out: str, schema: StructType) -> DataFrame:
    """Convert Stata files to Parquet and return the converted table."""
    read_stata(spark, paths, schema).write.parquet(out)
    return spark.read.schema(schema).parquet(out)
