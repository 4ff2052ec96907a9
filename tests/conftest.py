import pytest
from pyspark.sql import SparkSession


def build_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("quillframe-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return build_session()
