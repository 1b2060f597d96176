import pytest
from pyspark.sql import functions as F

from wageband.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, str(tmp_path_factory.mktemp("shared")), app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column function for each of a list of texts."""
    def run(expression, texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
        value = expression(F.col("t")).alias("v")
        return [r[1] for r in rows.select("i", value).orderBy("i").collect()]

    return run
