import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def supplier_bars(spark, sf):
    from panelwright.sources import bars
    df = bars.bars(spark, sf, "supplier").persist()
    df.count()
    return df


@pytest.fixture(scope="session")
def feats(supplier_bars):
    from panelwright.operators import features
    df = features.features(supplier_bars).persist()
    df.count()
    return df
