"""The driver's entry points, and the library's independence of its optional parts."""

import pathlib
import re
import subprocess
import sys

import __spark_entry__

ROOT = pathlib.Path(__file__).parent.parent


def test_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and all(map(callable, queries.values()))


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "foldspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_the_rest_works_without_them(tmp_path):
    for path in ROOT.rglob("*.py"):
        rel = path.relative_to(ROOT)
        if "llm" in rel.parts or rel.parts[0] == "tests" or rel.name == "corpus_pipeline.py":
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'risk_run' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
