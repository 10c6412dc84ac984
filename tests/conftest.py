import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from listenlens.session import get_session
    s = get_session("local[4]", app="listenlens-tests", shuffle_partitions=8,
                    extra={"spark.driver.memory": "4g"})  # the forests of the training run need more than 1 GB
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
