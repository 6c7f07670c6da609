import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablekit.functions.session import build_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "tablekit-tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def classification(spark):
    rows = [
        (25, 50000, "IT", 2, 0), (30, 60000, "HR", 5, 0), (35, 70000, "IT", 8, 1), (40, 80000, "Finance", 12, 0),
        (45, 90000, "HR", 15, 1), (50, 100000, "IT", 20, 0), (28, 52000, "Finance", 3, 1), (33, 65000, "HR", 7, 0),
        (38, 75000, "IT", 10, 1), (42, 85000, "Finance", 14, 0), (48, 95000, "HR", 18, 1), (29, 55000, "IT", 4, 0),
    ]
    names = "age bigint, salary bigint, department string, experience_years bigint, churn bigint, id bigint"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], names)


@pytest.fixture
def with_nulls(spark):
    rows = [
        (25, 50000, "IT", 0), (None, 60000, "HR", 1), (35, None, "IT", 0), (40, 80000, None, 1), (45, 90000, "HR", None),
        (None, 100000, "IT", 0), (28, None, "Finance", 1), (33, 65000, None, 0), (38, 75000, "IT", 1), (42, 85000, "Finance", 0),
    ]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "age bigint, salary bigint, department string, churn bigint, id bigint")
