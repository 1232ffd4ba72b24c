import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*e.queries()); assert not set(e.oracle_sql()) - set(e.queries())"


def names(at):
    env = os.environ | {"PYTHONPATH": str(at)}
    return set(subprocess.run([sys.executable, "-c", NAMES], cwd=at, env=env, capture_output=True, text=True, check=True).stdout.split())


def test_entry_works_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "siftstone", tmp_path / "siftstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    rest = names(tmp_path)
    assert "bm25_topk" in rest and not any(n.startswith("op") and n[2].isdigit() for n in rest) and "pipeline" not in rest
    assert rest <= names(ROOT)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the tables")
def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
