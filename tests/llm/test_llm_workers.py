"""Every query with workers that cannot import this package."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())

def imports(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([importlib.util.find_spec("gondola") is not None] * batch.num_rows)], ["found"])

assert not spark.range(8).mapInArrow(imports, "found boolean").where("found").count()
from gondola.llm import queries
for name, query in queries.queries().items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
    print("ran", name, flush=True)
"""


def test_queries_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, str(tmp_path / "shared")], cwd=tmp_path,
                          env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran op") == 13
