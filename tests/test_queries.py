"""Every engine query against its SQL in DuckDB, and the entry module without the corpus operators."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from strandline import queries

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", list(queries.ALL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    query, sql = queries.ALL[name]
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
    result = duck.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert sorted(([r[i] for i in at] for r in result.fetchall()), key=repr) == got


def test_delivery_holds_what_last_connections_get(spark, sf_dir):
    """Delivered to the connection of its time, an event after a session's last connection goes where ``connections`` sends it."""
    last = {r.session_id: r.queue for r in queries.connections(spark, sf_dir).collect()}
    got = {tuple(r) for r in queries.delivery(spark, sf_dir).select("session_id", "event_id", "queue").collect()}
    assert {r for r in got if last.get(r[0]) == r[2]} == {tuple(r) for r in queries.connections(spark, sf_dir).select("session_id", "event_id", "queue").collect()}


def test_entry_works_without_corpus_operators(tmp_path):
    for p in ("strandline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "strandline" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'plan_progress' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
