"""Sources, cleaning, statistics, quality, imputation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from venuegrid.operators import cleaning, impute, quality, statistics
from venuegrid.operators.quantiles import exact_quantiles
from venuegrid.schema import SOURCE_HEADERS
from venuegrid.sources import csv_source, tables

HEADER = ",".join(SOURCE_HEADERS)


def write_csv(tmp_path, lines, name="places.csv"):
    path = tmp_path / name
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_read_csv(spark, tmp_path):
    path = write_csv(
        tmp_path,
        ['Kopi "A",Cafe,10000,4,"Jl. Satu 1, Kota",1.5', "Soto,NA,n/a,5,null,0", '"Say ""hi""",Indoor,abc,3,x,1d'],
    )
    rows = csv_source.read_places(spark, path).orderBy("place_id").collect()
    assert [r["place_id"] for r in rows] == [0, 1, 2]
    assert rows[0]["Lokasi (maps)"] == "Jl. Satu 1, Kota"
    assert rows[1]["Tipe Tempat"] is None and rows[1]["Estimasi Harga (RP.)"] is None and rows[1]["Lokasi (maps)"] is None
    assert rows[2]["Nama Tempat"] == 'Say "hi"'
    clean = cleaning.clean_places(csv_source.read_places(spark, path)).collect()
    assert [(r["name"], r["price"], r["rating"], r["distance"]) for r in clean] == [('Kopi "A"', 10000.0, 4.0, 1.5)]


def test_read_errors(spark, tmp_path):
    with pytest.raises(AnalysisException):
        csv_source.read_places(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        csv_source.read_places(spark, str(tmp_path / "bad.csv"))


def test_positional_names(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b,c,d,e,f\nx,Cafe,1,2,l,3\n")
    got = csv_source.read_places(spark, str(tmp_path / "p.csv"), positional=True)
    assert got.columns == ["name", "type", "price", "rating", "location", "distance", "place_id"]
    assert cleaning.rename_by_position(spark.range(1)).columns == ["col_0"]
    seven = spark.createDataFrame([tuple("abcdefg")], "a string, b string, c string, d string, e string, f string, g string")
    assert cleaning.rename_by_position(seven).columns[-1] == "extra"


def test_row_ids_keep_file_order(spark, tmp_path):
    lines = [f"p{i},Cafe,{i + 1},3,l{i},1" for i in range(3000)]
    path = write_csv(tmp_path, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = csv_source.read_places(spark, path)
        names = [r[0] for r in df.orderBy("place_id").select("Nama Tempat").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert names == [f"p{i}" for i in range(3000)]


def test_row_ids_over_several_files(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    for part, size in (("b 2", 900), ("a 1", 40), ("c", 300)):
        write_csv(folder, [f"{part}-{i},Cafe,{i + 1},3,l{i},1" for i in range(size)], f"{part}.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = csv_source.read_places(spark, str(folder))
        names = [r[0] for r in df.orderBy("place_id").select("Nama Tempat").collect()]
        assert df.select("place_id").distinct().count() == 1240
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert names == [f"{p}-{i}" for p, n in (("a 1", 40), ("b 2", 900), ("c", 300)) for i in range(n)]


def test_exports_round_trip(spark, places, tmp_path):
    tables.export(places, str(tmp_path / "c"), "CSV")
    tables.export(places, str(tmp_path / "j"), "json")
    back = spark.read.schema(places.schema).option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.exceptAll(places).count() == 0 and back.count() == 7
    assert spark.read.schema(places.schema).json(str(tmp_path / "j")).exceptAll(places).count() == 0
    with pytest.raises(ValueError, match="unsupported format"):
        tables.export(places, str(tmp_path / "x"), "excel")


def test_publish_prefers_the_latest_stage(spark, places, tmp_path):
    store = str(tmp_path / "store")
    assert tables.read_published(spark, store).count() == 0
    tables.publish(places.drop("cluster"), store, tables.CLEANED)
    assert "cluster" not in tables.read_published(spark, store).columns
    tables.publish(places, store, tables.CLUSTERED)
    found = tables.read_published(spark, store, {"max_price": 20000})
    assert sorted(r["place_id"] for r in found.collect()) == [1, 3, 5]
    plan = tables.read_published(spark, store).where("cluster = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan


def test_ranges(spark):
    rows = [("a", "t", p, r, "l", d) for p, r, d in [
        ("0", "3", "1"), ("-1", "3", "1"), ("5", "0.99", "1"), ("5", "1", "0"), ("5", "5", "2"), ("5", "5.01", "1"), ("5", "3", "-0.1")]]
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in SOURCE_HEADERS))
    assert [(r["rating"], r["distance"]) for r in cleaning.clean_places(df).collect()] == [(1.0, 0.0), (5.0, 2.0)]


def test_missing_critical_values_only(spark):
    df = spark.createDataFrame(
        [(None, "t", "1", "1", "l", "1"), ("n", None, "1", "1", None, "1"), ("n", "t", None, "1", "l", "1")],
        ", ".join(f"`{h}` string" for h in SOURCE_HEADERS),
    )
    assert [(r["name"], r["type"]) for r in cleaning.clean_places(df).collect()] == [("n", None)]


def test_outliers_are_removed_one_column_after_the_other(spark):
    rows = [(float(10 + i % 5), float(1 + i % 4)) for i in range(40)] + [(1000.0, 100.0), (1000.0, 120.0), (12.0, 7.5)]
    df = spark.createDataFrame(rows, "price double, distance double")
    kept, fences = cleaning.drop_outliers(df)
    pdf = pd.DataFrame(rows, columns=["price", "distance"])
    for c in ("price", "distance"):
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        assert fences[c] == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
        pdf = pdf[pdf[c].between(*fences[c])]
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, pdf.values.tolist()))
    assert cleaning.drop_outliers(df.limit(0))[1] == {}


def test_quantiles_narrow_whatever_the_values(spark):
    """Hot values, ties and a sketch far too coarse for the few rows that are ranked."""
    rng = np.random.default_rng(3)
    data = np.concatenate([np.full(300, 5.0), np.arange(90) / 7, rng.normal(size=90), np.full(200, -1.0)])
    df = spark.createDataFrame([(float(x),) for x in data], "v double").coalesce(2)
    probs = [0.1, 0.77]
    got = exact_quantiles(df, ["v"], probs, direct_rows=20, accuracy=10)["v"]
    assert got == pytest.approx(np.quantile(data, probs).tolist(), rel=1e-12)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    header = list(SOURCE_HEADERS)
    swapped = [header[0], header[1], header[3], header[2], *header[4:]]
    for name, names in (("a", header), ("b", swapped)):
        (tmp_path / f"{name}.csv").write_text(",".join(names) + "\nx,t,1,2,l,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_source.read_places(spark, str(tmp_path)).collect()


def test_broken_stages_are_not_taken_for_absent_ones(spark, tmp_path):
    assert tables.read_published(spark, str(tmp_path)).count() == 0
    (tmp_path / "places_clustered").mkdir()
    with pytest.raises(AnalysisException):
        tables.read_published(spark, str(tmp_path))


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_quantiles_by_bracketing(spark, accuracy):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(0, 1, 4000), np.full(2500, 0.25), rng.exponential(1e6, 700)])
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.777, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, ["v"], probs, direct_rows=200, accuracy=accuracy)["v"]
    assert got == pytest.approx(np.quantile(data, probs).tolist(), rel=1e-12)
    assert exact_quantiles(df, ["v"], probs)["v"] == pytest.approx(got)
    two = df.withColumn("w", -F.col("v")).withColumn("e", F.lit(None).cast("double"))
    both = exact_quantiles(two, ["v", "w", "e"], [0.25, 0.5], direct_rows=1500, accuracy=accuracy)
    assert both["v"] == pytest.approx(np.quantile(data, [0.25, 0.5])) and both["e"] == [None, None]
    assert both["w"] == pytest.approx(np.quantile(-data, [0.25, 0.5]))


def test_summaries(spark, places):
    one = statistics.summary_stats(places).first()
    assert (one["total"], one["avg_rating"]) == (7, pytest.approx(29 / 7))
    none = statistics.summary_stats(places.limit(0)).first()
    assert tuple(none) == (0, 0.0, 0.0, 0.0)
    s = statistics.data_summary(places).first()
    assert (s["unique_types"], s["price_median"], s["price_min"], s["distance_max"]) == (3, 26000.0, 10000.0, 4.0)
    assert s["rating_std"] == pytest.approx(np.std([4, 5, 4, 3, 5, 4.5, 3.5], ddof=1))
    assert [tuple(r) for r in statistics.type_distribution(places).collect()] == [("Cafe", 2), ("Indoor", 2), ("Warung", 2)]
    assert statistics.percentile_of(places.limit(0), "price", 50).first()[0] == 0.0
    assert statistics.percentile_of(places, "price", 25).first()[0] == 13500.0


def test_cluster_stats(places):
    s = statistics.cluster_stats(places, 0).first()
    assert (s["total"], s["price_range"]["min"], s["price_range"]["max"], s["types"]) == (3, 10000, 15000, {"Warung": 2})
    assert statistics.cluster_stats(places, 9).count() == 0


def test_profile_and_violations(spark):
    df = spark.createDataFrame(
        [("a", "1", "9"), ("a", "1", "9"), ("b", None, "x"), (None, "-2", "3"), (None, "-2", "3"), (None, "-2", "3")],
        "name string, price string, rating string",
    )
    p = quality.table_profile(df).first()
    assert (p["total_rows"], p["total_columns"], p["duplicate_rows"]) == (6, 3, 3)
    assert p["missing"] == {"name": 3, "price": 1, "rating": 0}
    v = quality.rule_violations(df.withColumn("distance", F.lit("-1"))).first()
    assert tuple(v) == (1, 3, 1, 2, 0, 6)
    assert quality.validate(df).first()["is_valid"] is False


def test_quality_report(spark, places):
    fine = quality.quality_report(places.na.fill({"type": "x", "location": "y", "name": "z"})).first()
    assert (fine["score"], fine["status"], fine["issues"]) == (100.0, "Sangat Baik", [])
    bad = places.withColumn("price", F.when(F.col("place_id") == 1, -1.0).otherwise(F.col("price") * 100))
    r = quality.quality_report(bad.withColumn("rating", F.col("rating") + 2).withColumn("distance", -F.col("distance")), 4).first()
    # name, type and location are missing in 14.29 % of the rows
    assert len(r["issues"]) == 8 and r["score"] == 20.0 and r["status"] == "Perlu Perbaikan"
    assert len(r["recommendations"]) == 4
    assert r["statistics"]["missing_pct"]["type"] == 14.29 and r["statistics"]["potential_duplicates"] == 4
    empty = quality.quality_report(places.limit(0)).first()
    assert (empty["score"], empty["issues"]) == (0.0, ["the table is empty"])


def test_imputation(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "b", None), (2, None, "a", None), (None, float("nan"), None, None), (7, 5.0, "a", None), (8, 6.0, "b", None)],
        "n int, x double, s string, e string",
    )
    assert impute.handle_missing(df.drop("e"), "drop").count() == 3
    mean = impute.handle_missing(df, "fill_mean").collect()[2]
    assert (mean["n"], mean["x"], mean["s"], mean["e"]) == (4.5, pytest.approx(13 / 3), "a", "Unknown")
    median = impute.handle_missing(df, "fill_median").collect()[2]
    assert (median["n"], median["x"], median["s"]) == (4.5, 5.0, None)
    assert impute.handle_missing(df, "other") is df
