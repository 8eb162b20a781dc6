"""Settings and libraries that may be absent."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_local_session_without_a_shared_folder():
    out = run("""
from pyspark.sql import SparkSession
from klimawerk import session
class Unset:
    def get(self, name, default=None): return default
class Context:
    master, applicationId = "local[2]", "app-1"
    def getConf(self): return Unset()
class Session:
    conf, sparkContext = Unset(), Context()
first = session.shared_folder(Session())
assert first and session.shared_folder(Session()) == first
Context.master = "spark://host:7077"
try:
    session.shared_folder(Session())
    print("no error")
except ValueError:
    print("ValueError")
""")
    assert out.strip() == "ValueError"


def test_climate_queries_without_the_libraries_of_the_operators():
    out = run("""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in ("xxhash", "tokenizers", "regex"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(len([q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]))
""")
    assert int(out.strip().splitlines()[-1]) >= 84
