"""The driver's contract: workers without this package, and a package that is there but broken."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

import pytest

pytest.importorskip("panelscope.llm")

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
scratch = sys.argv[2]
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g")
         .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch).config("spark.sql.warehouse.dir", scratch + "/w").config("spark.checkpoint.dir", scratch + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
seen = spark.range(1).mapInPandas(lambda it: (f.assign(id=__import__("importlib").util.find_spec("panelscope") is not None) for f in it), "id boolean").first().id
assert not seen, "the workers have the package on their path"
import __spark_entry__ as entry
names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
assert len(names) == 14, names
for name in names:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_all_queries_run_on_workers_that_lack_the_package():
    """The repository is on the driver's path only, as on a cluster."""
    scratch = tempfile.mkdtemp(prefix="spark-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if outside := [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.abspath(p) != REPO]:
        env["PYTHONPATH"] = ":".join(outside)
    done = subprocess.run([sys.executable, "-c", _RUN, REPO, scratch], cwd=scratch, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) >= 14


@pytest.mark.parametrize(("broken", "raises"), [("panelscope.llm.quality", True), ("panelscope.llm", False), ("corpus_pipeline", False), ("panelscope.llm.common", True)])
def test_only_an_absent_part_is_forgiven(broken, raises):
    """A module that is missing inside of a present package must show."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
class Finder:
    def find_spec(self, name, path=None, target=None):
        if name == {broken!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Finder())
import __spark_entry__ as entry
print(len([n for n in entry.queries() if n.startswith("op")]))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, timeout=300)
    if raises:
        assert done.returncode and ("ImportError" in done.stderr or "ModuleNotFoundError" in done.stderr)
    else:
        assert done.stdout.strip() == "0", done.stderr
