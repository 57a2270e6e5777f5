"""The package stands without its optional subpackage, and nothing outside uses it."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_outside_imports_the_text_operators():
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT).as_posix()
        if rel.startswith(("flowloom/llm/", "tests/llm/")) or rel in ("corpus_pipeline.py", "__spark_entry__.py"):
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n == "corpus_pipeline" or "llm" in n.split(".") for n in names), rel


def test_entry_imports_without_the_text_operators():
    code = "import sys; sys.modules['flowloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'detect' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
