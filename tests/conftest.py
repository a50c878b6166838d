import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from slimctx.session import apply_defaults
    s = (SparkSession.builder.master("local[2]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "4g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    apply_defaults(s)
    # tests have no cluster checkpoint folder: set our own (only where unset)
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="slimctx-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


def make_files(spark, files: dict):
    from pyspark.sql import functions as F

    from slimctx.functions.paths import language_of
    df = spark.createDataFrame(sorted(files.items()), "path string, text string")
    return df.select("path", language_of(F.col("path")).alias("language"), "text")
