"""The supplied order and customer tables seen as a raw survey, one person per order.

Only the shape is survey-like; it feeds the queries and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import BANDED_WAVES, ETHNICITY_RULES, TOP_CODED_WAVE

# Labels of the age-band codes 1 to 21 (22 is open-ended, without label).
AGE_BAND_LABELS = {
    1: "0-1", 2: "2-4", 3: "5-7", 4: "8-10", 5: "11-12", 6: "13-15", 7: "16-19",
    **{8 + i: f"{20 + 5 * i}-{24 + 5 * i}" for i in range(14)},
}
FIRST_WAVE_WITH_WEIGHTS = 2003


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All waves with their own column names; absent columns are null."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_nationkey", "c_acctbal"
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    base = orders.join(customer, cust == F.col("c_custkey")).select(
        key.alias("row_id"),
        (F.lit(1991) + key % 29).cast("int").alias("_year"),
        (F.lit(1) + cust % 2).cast("int").alias("sex"),
        (F.lit(15) + (cust * 31 + key * 17) % 56).cast("int").alias("_age0"),
        "o_totalprice", "c_acctbal", "c_nationkey", "o_orderpriority",
    )
    key, wave = F.col("row_id"), F.col("wave")
    age = F.when(key % 97 == 0, -1).otherwise(F.col("_age0"))
    in_years = F.floor((F.col("age") - 20) / 5) + 8
    code = (
        F.when(key % 53 == 0, 22)
        .when(F.col("age") < 0, None)
        .when(F.col("age") <= 15, 6)
        .when(F.col("age") <= 19, 7)
        .otherwise(F.least(in_years, F.lit(22)))
        .cast("int")
    )
    bmi = (
        F.lit(13.0)
        + F.lit(10.0) * (F.col("o_totalprice") / F.lit(500000.0))
        + F.lit(10.0) * ((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0))
        + F.lit(0.06) * F.col("_age0")
        + F.lit(6.0) * ((key * 7919) % 1000 / F.lit(1000.0))
    )
    base = base.withColumn("wave", F.when(F.col("_year") == 1992, 1991).otherwise(F.col("_year")))
    base = base.withColumn("age", age)
    ethnicity = {}
    for first, last, name, _, _ in ETHNICITY_RULES:
        lower = ethnicity.get(name, F.lit(None).cast("int"))
        ethnicity[name] = F.when(wave.between(first, last), F.col("c_nationkey") % 5 + 1).otherwise(lower)
    return base.select(
        "row_id",
        "wave",
        F.when(wave == 1991, "1991-1992").otherwise(wave.cast("string")).alias("fld"),
        F.when(wave == 1991, F.col("_year") - 1900).alias("year"),
        "sex",
        "age",
        F.when(wave == TOP_CODED_WAVE, F.when(key % 53 == 0, 90).otherwise(F.col("age"))).alias("age90"),
        F.when(wave.between(*BANDED_WAVES), code).alias("age35g"),
        F.when(key % 211 == 0, 95.0).otherwise(bmi).alias("bmi"),
        F.when(key % 8 == 0, 2).otherwise(1).alias("bmiok"),
        *[c.alias(n) for n, c in ethnicity.items()],
        F.substring("o_orderpriority", 1, 1).cast("int").alias("samptype"),
        (key % 10 - 1).cast("int").alias("topqual2"),
        F.when(wave >= FIRST_WAVE_WITH_WEIGHTS, F.lit(0.5) + key % 100 / F.lit(100.0)).alias("wt_int"),
        (wave >= FIRST_WAVE_WITH_WEIGHTS).alias("has_wt_int"),
    )
