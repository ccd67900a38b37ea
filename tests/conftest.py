import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Value of a column function on one text."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
        return df.select(fn(*[F.col(n) for n in names])).first()[0]
    return run


@pytest.fixture
def pair_table(spark):
    def make(*pairs):
        return spark.createDataFrame(
            [(i, b, a) for i, (b, a) in enumerate(pairs)], "pair_id long, before string, after string")
    return make
