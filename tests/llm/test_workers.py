"""All operators on workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
conf = {{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()

def absent(_):
    try:
        import tessera
    except ImportError:
        return True
    return False

assert all(spark.sparkContext.parallelize(range(4), 4).map(absent).collect()), "workers see the package"
from tessera.llm.queries import QUERIES
for name, query in QUERIES.items():
    print(name, query(spark, "/root/testdata/sf0.001").count())
import corpus_pipeline
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
for name, stage in corpus_pipeline.STAGES:
    print(name, stage(spark, docs, "/root/testdata/sf0.001").count())
"""


def test_without_the_package_on_workers(tmp_path):
    repo = Path(__file__).parents[2]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(repo)).replace("def absent(_):", "def absent(_):\n    import sys", 1))
    got = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-3000:]
    assert len(got.stdout.splitlines()) == 15
