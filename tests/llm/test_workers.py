"""Every operator from another working directory: workers cannot import this repository's package."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from riskweave.session import build_session
spark = build_session("local[4]", 4, extra={{"spark.sql.warehouse.dir": {folder!r}, "spark.checkpoint.dir": {folder!r} + "/ck"}})
found = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib.util").util.find_spec("riskweave") is not None).collect()
assert found == [False], "the worker finds the package"
queries = entry.queries()
for name in {names!r}:
    n = queries[name](spark, "/root/testdata/sf0.001").count()
    assert n > 0, name
    print(name, n, flush=True)
"""
NAMES = ["op3_nearest_neighbours", "op5_language_id", "op7_url_filter", "op10_toxicity", "op11_alignment", "op12_fill_middle", "op13_quality_rules"]


@pytest.mark.parametrize("names", [NAMES, ["pipeline"]], ids=["operators", "pipeline"])
def test_workers_need_no_package(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, folder=str(tmp_path / "w"), names=names)], cwd=str(tmp_path),
                          env=env, capture_output=True, text=True, timeout=900)
    assert [line.split()[0] for line in done.stdout.splitlines()] == names, done.stderr[-3000:]
