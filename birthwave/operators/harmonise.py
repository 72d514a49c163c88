"""Harmonisation of drifting survey waves into one person table.

Every rule is a column expression over the wave number, so all waves go
through one projection and one filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..params import (
    BAND_CODES, BANDED_WAVES, EDUCATION_LABELS, ETHNICITY_RULES, NO_EDUCATION_WAVES,
    SAMPLE_RULES, TOP_CODE, TOP_CODED_WAVE, Params,
)
from .staging import join_summary

CLEAN_COLUMNS = ["row_id", "year", "sex", "age", "bmi", "edu", "wt_int", "birth"]


def wave_number(fld: Column) -> Column:
    return F.substring(fld, 1, 4).cast("int")


def survey_year(wave: Column, two_digit: Column) -> Column:
    """The first wave spans two years and carries its own two-digit year."""
    return F.when(wave == 1991, two_digit.cast("int") + 1900).otherwise(wave)


def ethnicity_kept(wave: Column, has: set[str]) -> Column:
    kept = F.lit(True)
    for i, (first, last, name, low, high) in enumerate(ETHNICITY_RULES):
        code = F.col(name).between(low, high) if name in has else F.lit(None).cast("boolean")
        when = wave <= last if i == 0 else wave.between(first, last)
        kept = F.when(when, code).otherwise(kept)
    return kept


def core_sample_kept(wave: Column, samptype: Column) -> Column:
    kept = F.lit(True)
    for first, last, low, high in SAMPLE_RULES:
        kept = F.when(wave.between(first, last), samptype.between(low, high)).otherwise(kept)
    return kept


def label_bounds(label: Column) -> tuple[Column, Column]:
    """Lowest and highest age of a label such as ``20-24``; null where it is no closed range."""
    ends = F.split(label, "-")
    return F.get(ends, F.lit(0)).try_cast("int"), F.get(ends, F.lit(1)).try_cast("int")


def band_label(code: Column, labels: dict[int, str]) -> Column:
    low, high = BAND_CODES
    usable = {k: v for k, v in labels.items() if low <= k <= high}
    return F.create_map(*[F.lit(v) for pair in usable.items() for v in pair])[code]


def band_bounds(code: Column, labels: dict[int, str]) -> tuple[Column, Column]:
    """Lowest and highest age of a band code; null where the label is no closed range."""
    return label_bounds(band_label(code, labels))


def age_in_bounds(low: Column, high: Column, row_id: str, seed: int) -> Column:
    """Uniform integer age between the bounds, fixed by seed and row."""
    u = draws.uniform("band_age", F.lit(seed), row_id)
    return (low + F.floor(u * (high - low + 1))).cast("int")


def age_from_band(code: Column, labels: dict[int, str], row_id: str, seed: int) -> Column:
    """Uniform integer age inside the band, fixed by seed and row."""
    return age_in_bounds(*band_bounds(code, labels), row_id, seed)


def education(wave: Column, code: Column) -> Column:
    labels = F.array(*[F.lit(v) for v in EDUCATION_LABELS])
    label = F.when(code.between(1, len(EDUCATION_LABELS)), F.get(labels, code.cast("int") - 1))
    return F.when(~wave.between(*NO_EDUCATION_WAVES), label)


def harmonise(df: DataFrame, band_labels: dict[int, str] | DataFrame, params: Params = Params()) -> DataFrame:
    """Clean person table of raw rows that carry their wave number, or its folder in ``fld``.

    ``band_labels`` are the labels of the age bands: by code, or as a table
    (``fld, code, label``) of what each wave's own files say.
    ``has_wt_int`` tells whether the wave has a weight column at all: the
    default weight one stands for an absent column, never for a null weight.
    """
    has = {c.lower() for c in df.columns}

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in has else F.lit(None).cast(kind)

    wave = F.col("wave")
    rows = df if "wave" in has else df.withColumn("wave", wave_number(F.col("fld")))
    code = col("age35g", "int")
    if isinstance(band_labels, DataFrame):
        low, high = BAND_CODES
        lookup = band_labels.where(F.col("code").between(low, high)).select("fld", F.col("code").alias("_code"), F.col("label").alias("_band")).distinct()
        rows = join_summary(rows.withColumn("_code", code), lookup, ["fld", "_code"])
        label = F.col("_band")
    else:
        label = band_label(code, band_labels)
    rows = rows.where(ethnicity_kept(wave, has)).where(core_sample_kept(wave, col("samptype", "int")))
    age90 = col("age90", "int")
    age = (
        F.when(wave == TOP_CODED_WAVE, F.when(age90 != TOP_CODE, age90))
        .when(wave.between(*BANDED_WAVES), age_in_bounds(*label_bounds(label), "row_id", params.seed))
        .otherwise(col("age", "int"))
    )
    weight = F.when(F.col("has_wt_int"), col("wt_int", "double")).otherwise(F.lit(1.0))
    bmi = F.when(F.col("bmiok") == 1, F.col("bmi"))
    rows = rows.select(
        "row_id",
        survey_year(wave, col("year", "int")).cast("int").alias("year"),
        F.when(F.col("sex") == 1, "Male").when(F.col("sex").isNotNull(), "Female").alias("sex"),
        age.cast("int").alias("age"),
        bmi.cast("double").alias("bmi"),
        education(wave, col("topqual2", "int")).alias("edu"),
        weight.alias("wt_int"),
    )
    return range_clean(rows, params)


def range_clean(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """Impossible ages and body-mass values become null; birth year is derived."""
    rows = rows.withColumns(
        {
            "age": F.when(F.col("age") > 0, F.col("age")),
            "bmi": F.when(F.col("bmi").between(params.bmi_low, params.bmi_high), F.col("bmi")),
        }
    )
    return rows.withColumn("birth", F.col("year") - F.col("age"))
