import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_data_subpackage(tmp_path):
    for part in ("tessera", "__spark_entry__.py"):
        src = os.path.join(HERE, part)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / part)
    shutil.rmtree(tmp_path / "tessera/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'change_topology' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_subpackage():
    for at, _, files in os.walk(os.path.join(HERE, "tessera")):
        if os.sep + "llm" not in at:
            for f in files:
                if f.endswith(".py"):
                    assert "tessera.llm" not in open(os.path.join(at, f)).read(), f


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
