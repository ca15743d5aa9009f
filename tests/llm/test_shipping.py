"""Executors need no installed package: every query and the pipeline run in workers that cannot import this library."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import corpus_pipeline
from boardstat.llm import queries
for name, query in [*queries.QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
    print("ran", name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_queries_run_where_the_library_is_absent(tmp_path):
    script = tmp_path / "away.py"
    script.write_text(SCRIPT.format(root=str(Path(__file__).resolve().parents[2])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.count("ran ") == 14
