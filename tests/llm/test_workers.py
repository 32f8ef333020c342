"""Workers need no copy of the package: what Python workers run travels by value."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, {root!r})
from seatward.session import local_session
from seatward.llm import queries
spark = local_session("apart", "2", 2)
for name in ("op5_language", "op7_bpe", "op10_warc_derivatives", "op11_suffix_tree", "op12_prefix_trie", "op13_importance_resampling"):
    queries.QUERIES[name](spark, {folder!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")
def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(Path(__file__).resolve().parents[2]), folder=FOLDER)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
