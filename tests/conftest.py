import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from costmart.session import clear_shared, local_session
    s = local_session("*", shuffle_partitions=8, app="costmart-tests")
    yield s
    clear_shared(s)
    s.stop()


@pytest.fixture(scope="session")
def billing_small(spark):
    from costmart.sources.fixture import billing
    return billing(spark, SF_SMALL).cache()
