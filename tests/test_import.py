"""The entry can be read in a fresh process, before any session exists, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
READ = "import __spark_entry__ as e; from pyspark import SparkContext; q = e.queries(); s = e.oracle_sql(); assert SparkContext._active_spark_context is None; assert set(s) <= set(q); print(len(q))"


def _read(at: str) -> int:
    done = subprocess.run([sys.executable, "-c", READ], cwd=at, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": f"{at}:{os.environ.get('PYTHONPATH', '')}"})
    assert done.returncode == 0, done.stderr
    return int(done.stdout.split()[-1])


def test_entry_without_a_session():
    assert _read(ROOT) > 60


def test_entry_without_the_training_data_part(tmp_path):
    for name in ("docloom", "tests"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    assert 60 < _read(str(tmp_path)) <= _read(ROOT)
