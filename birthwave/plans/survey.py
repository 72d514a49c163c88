"""The clean person table: one plan from raw waves, written once and read by every analysis."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.harmonise import harmonise
from ..operators.staging import stage, stage_root
from ..params import Params
from ..sources.sinks import write_clean
from ..sources.survey_view import AGE_BAND_LABELS, FIRST_WAVE_WITH_WEIGHTS, raw_survey
from ..sources.waves import listing, scan_folder

_written: dict[tuple[str, str, Params], DataFrame] = {}


def clean_survey(spark: SparkSession, sf_dir: str, params: Params = Params()) -> DataFrame:
    return harmonise(raw_survey(spark, sf_dir), AGE_BAND_LABELS, params)


def clean_table(spark: SparkSession, sf_dir: str, params: Params = Params()) -> DataFrame:
    """The clean table as a stage table of this session."""
    key = (spark.conf.get("spark.app.id", "local"), sf_dir, params)
    if key not in _written:
        _written[key] = stage(clean_survey(spark, sf_dir, params), "clean")
    return _written[key]


def write_waves(raw: DataFrame, path: str) -> None:
    """Raw survey as files by wave; early waves have no weight column and names in another case."""
    early = raw.where(F.col("wave") < FIRST_WAVE_WITH_WEIGHTS).drop("wt_int")
    early = early.select("fld", *[F.col(c).alias(c.upper()) for c in early.columns if c not in ("fld", "row_id", "wave", "has_wt_int")])
    late = raw.where(F.col("wave") >= FIRST_WAVE_WITH_WEIGHTS).drop("row_id", "wave", "has_wt_int")
    early.write.partitionBy("fld").parquet(f"{path}/early")
    late.write.partitionBy("fld").parquet(f"{path}/late")


def clean_files(spark: SparkSession, root: str, out: str, band_labels=AGE_BAND_LABELS, params: Params = Params()) -> DataFrame:
    """Raw wave files below ``root`` (folders ``fld=...``) to a clean table in ``out``, one folder per survey year."""
    files = listing(spark, root).withColumn("fld", F.regexp_extract("path", "/fld=([^/]+)/", 1))
    clean = harmonise(scan_folder(spark, files), band_labels, params)
    write_clean(clean, out)
    return spark.read.parquet(out)


def clean_through_files(spark: SparkSession, sf_dir: str, params: Params = Params()) -> DataFrame:
    """The survey written as wave files, scanned, cleaned, written by year and read back."""
    path = f"{stage_root(spark)}/wave-files-{uuid.uuid4().hex}"
    write_waves(raw_survey(spark, sf_dir), f"{path}/raw")
    return clean_files(spark, f"{path}/raw", f"{path}/clean", params=params)
