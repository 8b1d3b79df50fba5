import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compare import session

    spark = session()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def mails(spark):
    """Make a mail table from (subject, sender, body) rows."""

    def make(*rows):
        numbered = [(i, f"m{i}", *row) for i, row in enumerate(rows)]
        schema = "seq bigint, id string, subject string, sender string, body string"
        return spark.createDataFrame(numbered, schema)

    return make
