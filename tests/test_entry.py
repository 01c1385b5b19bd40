import subprocess
import sys

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_contract():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40


def test_imports_without_the_optional_parts(tmp_path):
    """The package and the entry work where the optional folders are gone."""
    import pathlib
    import shutil

    root = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) >= 40, out.stderr
