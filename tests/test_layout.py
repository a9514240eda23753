"""The base stands without the text subpackage, and the entry points agree with each other."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["seriesforge/llm", "tests/llm"], ["seriesforge/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_base_without_the_text_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), len(set(e.oracle_sql()) - set(q)), 'pipeline' in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, strange, pipeline = out.stdout.split()
    assert int(n) >= 72 and strange == "0" and pipeline == "False"
