import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as entry, bench
names, twins = set(entry.queries()), set(entry.oracle_sql())
assert len(names) > 100 and twins <= names
assert not any(n.startswith("op") or n == "pipeline" for n in names)
"""


@pytest.mark.parametrize("left", ["corpus_pipeline.py", None])
def test_entry_works_without_the_optional_subpackage(tmp_path, left):
    skipped = {".git", "__pycache__", "llm"} | ({"corpus_pipeline.py"} if left is None else set())
    shutil.copytree(TOP, tmp_path / "copy", ignore=lambda _, names: skipped & set(names))
    assert (tmp_path / "copy" / "corpus_pipeline.py").exists() == (left is not None)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
