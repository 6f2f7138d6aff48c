"""The shared folder where ``spark.checkpoint.dir`` is unset."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from hammertrail.session import cut_lineage, local_session, shared_dir
spark = local_session("2", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert cut_lineage(spark.range(3)).count() == 3
assert shared_dir(spark) == shared_dir(spark)
print("checked")
"""


def test_a_local_session_makes_its_own_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert "checked" in done.stdout, done.stderr[-2000:]
