"""The entry point with and without the optional training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), any(k.startswith('op1_') for k in q), 'pipeline' in q, set(s) <= set(q))"


@pytest.mark.parametrize("left", ["nothing", "pipeline", "caches"])
def test_queries_without_the_subpackage(tmp_path, left):
    for name in ("waymark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "waymark" / "llm", ignore_errors=True)
    if left == "pipeline" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if left == "caches":
        (tmp_path / "waymark" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, operator, pipeline, known = out.stdout.split()
    assert int(n) > 50 and (operator, pipeline, known) == ("False", "False", "True")


def test_other_failing_imports_are_errors(tmp_path):
    for name in ("waymark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    (tmp_path / "waymark" / "llm").mkdir(exist_ok=True)
    (tmp_path / "waymark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "waymark" / "llm" / "registry.py").write_text("import no_such_module_here\n")
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode and "no_such_module_here" in out.stderr
