import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from birthwave.operators.harmonise import harmonise
from birthwave.operators.staging import join_summary, stage
from birthwave.plans.survey import clean_files, clean_table, write_waves
from birthwave.sources import catalog, sinks, stata, waves
from birthwave.sources.survey_view import AGE_BAND_LABELS, raw_survey

# Small drifting waves: names differ in case, types differ, columns come and go.
WAVES = {
    "1991-1992": ("year int, Sex int, Age int, BMI double, BMIok int, Ethnic int, TopQual2 int",
                  [(91, 1, 30, 24.0, 1, 1, 1), (92, 2, 31, 25.0, 2, 1, 9), (92, 2, 40, 26.0, 1, 2, 1)]),
    "2006": ("Sex bigint, Age int, bmi double, bmiok int, ethinda int, SampType int, topqual2 int, wt_int double",
             [(1, 0, 75.0, 1, 1, 1, 2, 0.7), (2, 50, 30.0, 1, 1, 2, 3, None), (2, 50, 30.0, 1, 1, 3, 3, 1.0)]),
    "2014": ("Sex int, Age90 int, BMI double, BMIOK int, origin2 int, topqual2 int, wt_int double",
             [(1, 90, 22.0, 1, 1, 4, 1.0), (None, 44, 21.0, 1, 1, 8, 1.0)]),
    "2016": ("Sex int, Age35g int, BMI double, BMIOK int, origin2 int, topqual2 int, wt_int double",
             [(1, 8, 22.0, 1, 1, 4, 1.0), (1, 22, 22.0, 1, 1, 4, 1.0), (1, 9, 22.0, 1, None, 4, 1.0)]),
}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("waves")
    for fld, (schema, rows) in WAVES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{fld}/eul.parquet")
    return str(root)


def test_waves_become_one_clean_table(spark, root):
    raw = waves.union_waves([waves.scan_wave(spark, f"{root}/{f}/eul.parquet", f) for f in WAVES])
    clean = harmonise(raw, AGE_BAND_LABELS)
    assert clean.columns == ["row_id", "year", "sex", "age", "bmi", "edu", "wt_int", "birth"]
    got = [tuple(r)[1:] for r in clean.orderBy("row_id").collect()]
    assert got[:5] == [
        (1991, "Male", 30, 24.0, "NVQ 4/5", 1.0, 1961), (1992, "Female", 31, None, None, 1.0, 1961),
        (2006, "Male", None, None, "HE Below Degree", 0.7, None), (2006, "Female", 50, 30.0, "NVQ3", None, 1956),
        (2014, "Male", None, 22.0, "NVQ2", 1.0, None),
    ]
    assert got[5] == (2014, None, 44, 21.0, "Current Student", 1.0, 1970)
    assert 20 <= got[6][2] <= 24 and got[7][2] is None and len(got) == 8
    assert clean.select("row_id").distinct().count() == 8


def test_scan_reads_only_the_survey_columns(spark, root):
    plan = waves.scan_wave(spark, f"{root}/2016/eul.parquet", "2016").select("row_id", "bmi")._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {f.split(":")[0] for f in read.split(",")} <= {"BMI", "_tmp_metadata_row_index"}


def test_a_folder_of_waves_is_numbered_from_its_listing(spark, root):
    listed = waves.listing(spark, root).withColumn("fld", F.regexp_extract("path", r"/([^/]+)/eul\.parquet/", 1))
    raw = waves.scan_folder(spark, listed)
    one_by_one = waves.union_waves([waves.scan_wave(spark, f"{root}/{f}/eul.parquet", f) for f in WAVES])
    assert sorted(map(tuple, raw.select("row_id", "fld", "bmi").collect())) == sorted(map(tuple, one_by_one.select("row_id", "fld", "bmi").collect()))
    assert raw.select("row_id").distinct().count() == 11
    with pytest.raises(ValueError):
        waves.scan_folder(spark, listed.limit(0))


def test_raw_files_to_a_pruned_clean_table(spark, sf_dir, tmp_path):
    raw = raw_survey(spark, sf_dir)
    write_waves(raw, f"{tmp_path}/raw")
    clean = clean_files(spark, f"{tmp_path}/raw", f"{tmp_path}/clean")
    late = clean.where("year = 2010")
    assert "PartitionFilters: [isnotnull(year" in late._jdf.queryExecution().executedPlan().toString()
    want = harmonise(raw, AGE_BAND_LABELS)
    facts = lambda df: sorted(map(tuple, df.groupBy("year", "sex", "edu").agg(F.count("*"), F.count("age"), F.round(F.sum("bmi"), 6), F.sum("wt_int")).collect()), key=repr)
    assert facts(clean) == facts(want)
    assert clean.select("row_id").distinct().count() == clean.count()


def test_value_labels_are_a_lookup(spark, tmp_path):
    (tmp_path / "2016").mkdir()
    people = pd.DataFrame({"sex": [1, 2, 1, 2], "age35g": [1, 2, 3, 9], "bmi": [20.0, 21.0, 22.0, 23.0], "bmiok": [1] * 4, "origin2": [1] * 4})
    people.to_stata(tmp_path / "2016" / "eul.dta", write_index=False, value_labels={"age35g": {1: "30-30", 2: "41-41", 3: "90+"}})
    labels = stata.stata_value_labels(spark, f"{tmp_path}/2016/*.dta")
    assert {(r["name"], r["code"], r["label"]) for r in labels.collect()} == {("age35g", 1, "30-30"), ("age35g", 2, "41-41"), ("age35g", 3, "90+")}
    schema = T.StructType.fromDDL("path string, sex int, age35g int, bmi double, bmiok int, origin2 int")
    raw = stata.read_stata(spark, f"{tmp_path}/2016/*.dta", schema).withColumns(
        {"fld": F.lit("2016"), "row_id": F.monotonically_increasing_id(), "has_wt_int": F.lit(False)}
    )
    own = labels.where("name = 'age35g'").withColumn("fld", F.lit("2016"))
    got = harmonise(raw.drop("path"), own).orderBy("bmi").select("age").collect()
    assert [r[0] for r in got] == [30, 41, None, None]


def test_catalogue_rules(spark, tmp_path):
    for name in ("1993/any.parquet", "1999/wave99ai.parquet", "1999/other.parquet", "2010/x_eul_v1.parquet", "docs/eul.parquet"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * 1024)
    got = catalog.rank_files(catalog.file_catalog(spark, str(tmp_path))).orderBy("fld").collect()
    assert [(r["fld"], r["path"].rsplit("/", 1)[1], r["fld_files"]) for r in got] == [
        ("1993", "any.parquet", 1), ("1999", "wave99ai.parquet", 1), ("2010", "x_eul_v1.parquet", 1)
    ]
    assert got[0]["size"] == 1024 / 1024**2


def test_dictionary_keeps_labels_through_parquet(spark, tmp_path):
    schema = T.StructType([T.StructField("bmi", T.DoubleType(), True, {"label": "Body mass"}), T.StructField("x", T.IntegerType())])
    spark.createDataFrame([(1.0, 1)], schema).write.parquet(f"{tmp_path}/a")
    got = catalog.variable_dictionary(spark, [f"{tmp_path}/a"]).select("name", "label").distinct().orderBy("name").collect()
    assert [(r["name"], r["label"]) for r in got] == [("bmi", "Body mass"), ("x", "")]


def test_stata_folder_becomes_parquet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        pd.DataFrame({"sex": [1, 2], "bmi": [20.0 + i, None]}).to_stata(
            tmp_path / "in" / f"w{i}.dta", write_index=False, variable_labels={"bmi": "Body mass"}
        )
    schema = T.StructType.fromDDL("path string, sex int, bmi double, wt double")
    out = stata.ingest_stata(spark, f"{tmp_path}/in/*.dta", f"{tmp_path}/out", schema)
    assert out.count() == 6 and out.where("bmi is null").count() == 3 and out.where("wt is not null").count() == 0
    labels = stata.stata_dictionary(spark, f"{tmp_path}/in/*.dta").where("name = 'bmi'").select("label").distinct().collect()
    assert [r[0] for r in labels] == ["Body mass"]


def test_sinks(spark, sf_dir, tmp_path):
    clean = clean_table(spark, sf_dir)
    sinks.write_clean(clean, f"{tmp_path}/clean")
    back = spark.read.parquet(f"{tmp_path}/clean").where("year = 1999")
    assert back.count() == clean.where("year = 1999").count()
    assert "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()
    sinks.write_csv(clean.groupBy("year").count(), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 29


def test_stage_cuts_lineage_and_summaries_are_broadcast_only_when_small(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 50)
    assert "Range" not in stage(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    summary = df.groupBy("g").agg(F.max("id").alias("m"))
    small, large = join_summary(df, summary, ["g"]), join_summary(df, summary, ["g"], max_rows=10)
    assert "LocalRelation" in small._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(small.collect()) == sorted(large.collect())
