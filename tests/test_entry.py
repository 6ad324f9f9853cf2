"""The driver's contract, also where the llm subpackage is gone."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["case_id", "code", "ig"]


def test_without_llm(tmp_path):
    for name in ("evidloom", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(f"{ROOT}/{name}") if name.endswith(".py") else None
    (tmp_path / "evidloom").mkdir()
    for name in os.listdir(f"{ROOT}/evidloom"):
        if name != "llm":
            (tmp_path / "evidloom" / name).symlink_to(f"{ROOT}/evidloom/{name}")
    code = f"import sys; sys.path = [p for p in sys.path if p not in ('', {ROOT!r})]; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env=env)
