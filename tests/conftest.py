import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haltscope.functions.calendar import trading_calendar  # noqa: E402
from haltscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def calendar(spark):
    return trading_calendar(spark, date(2019, 1, 1), date(2027, 12, 31)).cache()
