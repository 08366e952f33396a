import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from liftlake.session import CORE_CONF, checkpoint_dir
    b = (SparkSession.builder.master("local[*]").appName("liftlake-tests")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in CORE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # tests set their own only because none is configured
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="liftlake-test-", dir="/tmp")
