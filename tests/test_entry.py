"""The entry point, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150


def test_flagship(spark):
    import __spark_entry__ as e

    got = e.entry(spark).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4]


def test_imports_without_the_corpus_operators():
    code = (
        "import sys; sys.modules['cellweave.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert len(e.queries()) > 150"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "cellweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
