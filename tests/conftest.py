import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from helixframe.session import get_spark
    # tests set the folders that a cluster names itself
    tmp = tmp_path_factory.mktemp("spark")
    s = get_spark("local[4]", app="helixframe-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": str(tmp / "checkpoints"), "spark.sql.warehouse.dir": str(tmp / "warehouse")})
    yield s
    s.stop()
