import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from puckline.session import BASE_CONF

    ckpt = tempfile.mkdtemp(prefix="puckline-test-ckpt-")
    b = (SparkSession.builder.master("local[*]").appName("puckline-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", ckpt))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="puckline-test-")
