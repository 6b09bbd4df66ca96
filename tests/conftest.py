import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trade_insights.session import local_session
    s = local_session("*", shuffle_partitions=8, app_name="trade_insights-tests")
    yield s


SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def exports(spark):
    from trade_insights.sources import fixture_exports
    return fixture_exports(spark, SF_SMALL)
