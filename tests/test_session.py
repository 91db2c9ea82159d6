"""Sessions without settings of the machine's."""

import os
import subprocess
import sys

from tests.conftest import ROOT

PROGRAM = """
from pyspark.sql import SparkSession
from chronoweave.session import cut_lineage, shared_folder
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None), "a setting of the machine's is in force"
assert cut_lineage(spark.range(5)).count() == 5
where = shared_folder(spark)
spark.range(3).write.parquet(where)
assert spark.read.parquet(where).count() == 3 and where != shared_folder(spark)
print("done")
"""


def test_plain_session(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    got = subprocess.run([sys.executable, "-c", PROGRAM], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert got.stdout.strip().endswith("done"), got.stderr[-2000:]


def test_no_local_folder_on_a_cluster():
    import pytest

    from chronoweave.session import shared_folder

    class Other:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Other)
