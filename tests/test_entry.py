"""The driver contract holds with the llm folders and without them."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT

COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith(('op', 'pipeline')) for n in q))"


def counted(where):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=where, env=env, capture_output=True, text=True, check=True).stdout.split()
    return [int(x) for x in out[-2:]]


def test_entry_without_llm(tmp_path):
    for name in ("__spark_entry__.py",):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "emberline"), tmp_path / "emberline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    total, llm = counted(tmp_path)
    assert llm == 0 and total > 70


def test_entry_names():
    import __spark_entry__ as e

    assert "riskiest_hours" in e.queries() and "riskiest_hours" in e.oracle_sql()


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "emberline")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert "emberline.llm" not in f.read()


def test_flagship(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["hr", "raw", "risk", "band"] and out.count() > 0
