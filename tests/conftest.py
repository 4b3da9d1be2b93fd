import os
import sys
from datetime import date

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleanframe.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, memory="6g", checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def tides(spark):
    """52 readings of tide gauges in four harbours, with one null in most columns."""

    def reading(i):
        return (
            i,
            ("Brest", "Cadiz", "Delfzijl", "Esbjerg")[i % 4],
            ("Float 1", "Float 2", "Radar")[i % 3],
            None if i == 50 else 2.5 * ((i * 11) % 52) - 31.25,
            None if i == 51 else 3 + (i * 7) % 41,
            date(2023, 1 + i // 5, 1 + (i * 3) % 28),
            None if i == 49 else ("clear", "fog", "rain")[i % 3],
            None if i == 48 else f"crew {i % 7}",
            None if i == 51 else i % 2 == 1,
        )

    schema = (
        "id bigint, harbour string, gauge string, level double, samples bigint, taken date, sky string, "
        "observer string, checked boolean"
    )
    return spark.createDataFrame([reading(i) for i in range(1, 53)], schema)
