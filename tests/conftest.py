import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

PLACE = "place_id long, name string, type string, price double, rating double, location string, distance double, cluster int"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def places(spark):
    rows = [
        (1, "Soto Banjar", "Warung", 10000.0, 4.0, "https://a.example/1", 1.0, 0),
        (2, "Kopi Senja", "Cafe", 30000.0, 5.0, "https://a.example/2", 2.0, 1),
        (3, "Nasi Kuning", "Warung", 12000.0, 4.0, "Jl. Merdeka 3", 1.0, 0),
        (4, "Kopi Pagi", "Cafe", 26000.0, 3.0, "https://a.example/4", 0.5, 1),
        (5, "Bakso 50%", None, 15000.0, 5.0, "https://a.example/5", 2.0, 0),
        (6, "Steak (House)", "Indoor", 90000.0, 4.5, None, 4.0, 2),
        (7, None, "Indoor", 80000.0, 3.5, "Jl. Merdeka 7", 3.0, 2),
    ]
    return spark.createDataFrame(rows, PLACE)


def ids(df):
    return [r["place_id"] for r in df.collect()]
