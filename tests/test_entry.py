import importlib
import subprocess
import sys

import duckdb
import pytest

from tidewire.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[k]) for k in cols) for r in df.collect())
    rel = c.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(show(r[names.index(k)]) for k in cols) for r in rel.fetchall())


def test_imports_without_the_optional_subpackage(tmp_path):
    import pathlib
    import shutil

    repo = pathlib.Path(__file__).parents[1]
    shutil.copytree(repo / "tidewire", tmp_path / "tidewire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from tidewire.streaming import jobs

    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, ordinal int")
    df.write.parquet(src)
    for k in range(2):
        q = jobs.append_new(jobs.landed(spark, src, "id string, ordinal int"), str(tmp_path / "out"), "id", str(tmp_path / f"ck{k}"))
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
