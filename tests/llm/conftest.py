import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, fp string, key string"


@pytest.fixture
def docs(spark):
    def make(texts):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)], DOCS)

    return make
