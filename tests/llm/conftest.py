import datetime as dt

import pytest

T0 = dt.datetime(2025, 1, 1)


@pytest.fixture
def when():
    return T0
