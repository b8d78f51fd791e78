import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillstrata.session import local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture
def records(spark):
    rows = [
        (0, "B", "where is parcel {{Order Number}}", "order", "TRACK_ORDER", "It left on {{Date}} from {{City}}."),
        (1, "", "please stop order {{Order Number}}", "ORDER", "cancel_order", "Stopped, nothing is charged."),
        (2, "Q", "  \n\t ", "REFUND", "get_refund", "Your {{Amount}} is on the way."),
        (3, "B", "where is parcel {{Order Number}}", "ORDER", "track_order", "Soon."),
        (4, "B", "refund please", "REFUND", "get_refund", "No."),
        (5, None, "ab", " ", "x", None),
    ]
    from quillstrata.schema import RECORD_SCHEMA

    return spark.createDataFrame(rows, RECORD_SCHEMA)
