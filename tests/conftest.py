import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from leaselake.session import local_session, release_work

    session = local_session("leaselake-tests", work_dir=str(tmp_path_factory.mktemp("work")))
    yield session
    release_work(session)


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function on literal inputs, one row each."""
    from pyspark.sql import functions as F

    def run(function, values, type_="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
        out = rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()
        return [r.o for r in out]

    return run
