import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.executorEnv.OMP_NUM_THREADS", "1")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    # the shared folder comes from the session (spark.checkpoint.dir); only
    # when that is unset does shared_dir create a local one, as tests need
    from quarry.session import clear_stages, shared_dir
    shared_dir(s)
    yield s
    clear_stages(s)
    s.stop()
