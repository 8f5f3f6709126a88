import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from avalista.session import get_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def loan(**changes):
    """One plain loan; override what a test is about."""
    row = {
        "LoanNr": 1, "State": "CDMX", "SCIAN": "46", "Bank": "Banorte", "Term": 24, "NoEmp": 8, "NewExist": 2,
        "UrbanRural": 1, "GrAppv": 400000.0, "NAFIN_Appv": 220000.0, "Portion": 0.55, "RealEstate": 0,
        "Recession": 0, "Default": 0, "ChgOffPrinGr": 0.0, "RevLineCr": "N",
    }
    row.update(changes)
    return row


@pytest.fixture(scope="session")
def make_loans(spark):
    return lambda *rows: spark.createDataFrame([loan(**r) for r in rows])
