import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lectern.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session, "checks")
    yield session
    session.stop()


def chat_rows(spark, records):
    """``key, messages`` from lists of (role, content)."""
    rows = [(str(i), m) for i, m in enumerate(records)]
    return spark.createDataFrame(
        rows, "key string, messages array<struct<role:string,content:string>>"
    )


def told(row):
    return [(m["role"], m["content"]) for m in row["messages"]]
