import pytest

from markwise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g", "spark.log.level": "ERROR",
        },
    )
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session
    session.stop()
