import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from klimawerk.schema import MEASURES  # noqa: E402
from klimawerk.session import local_session  # noqa: E402

FIXTURES = Path(__file__).resolve().parent / "fixtures"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def raw_days(spark):
    """Raw rows from (station_id, ISO day or compact number, {measure: value}); other measures are NULL."""
    def make(rows):
        flat = [
            (station, int(str(day).replace("-", "")), *[_float(values.get(m)) for m in MEASURES])
            for station, day, values in rows
        ]
        return spark.createDataFrame(flat, "station_id string, MESS_DATUM int, " + ", ".join(f"{m} double" for m in MEASURES))

    return make


def _float(value):
    return None if value is None else float(value)
