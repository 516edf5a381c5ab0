"""The driver contract with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e, re; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and not any(re.match('op[0-9]|pipeline', n) for n in q), sorted(q); print(len(q))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_operators(tmp_path, pipeline):
    from emberframe.plans import catalog

    for name in ("emberframe", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if (REPO / name).is_dir():
            shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) == len(catalog.queries())
