import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    # Small inputs: compiling generated code would take most of the time.
    conf = {"spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"}
    return SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
