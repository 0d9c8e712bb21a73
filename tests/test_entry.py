"""The driver's contract."""

from __future__ import annotations

import __spark_entry__


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 80 and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["auroc"]


def test_entry_without_the_corpus_operators(tmp_path):
    """With quillon.llm and the pipeline gone, the rest imports and has its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, capture_output=True)
