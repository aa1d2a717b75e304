import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {ROOT!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from quarrylight.session import local_session
spark = local_session("4", 4, "2g")
for name in ("sql_script_rules", "sql_statements", "taint_rules", "script_calls", "bodies_redacted", "vector_topk_batch"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("done")
"""


def test_python_stages_run_from_another_folder(tmp_path):
    """Workers find the package though the driver was started elsewhere and nothing is installed."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
