"""The package reaches workers that cannot import it from their own path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from seqmine.session import builder, ship
from seqmine.sources import records
spark = (builder().master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1] + "/shared")
         .getOrCreate())
name = ship(spark)
assert ship(spark) == name
sys.path.remove({ROOT!r})
print("records", records.read_records(spark, sys.argv[1] + "/image", 4).where("pos > 1").count())
spark.stop()
"""


def test_workers_import_the_shipped_package(tmp_path):
    (tmp_path / "image").write_bytes(bytes(40))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "records 8" in done.stdout, done.stderr[-3000:]
