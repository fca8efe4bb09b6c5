"""The entry module works where the llm folders and the pipeline have been taken out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without(tmp_path):
    shutil.copytree(f"{ROOT}/scenelake", tmp_path / "scenelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=120)


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(f"{ROOT}/scenelake"):
        if "llm" in folder.split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "scenelake.llm" not in open(os.path.join(folder, f)).read(), f
