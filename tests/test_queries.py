"""Every query with SQL against that SQL on the smallest tables; the driver's contract."""

import datetime
import decimal
import math
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from braidwork.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, duck, folder, name):
    df = registry.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    answer = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in answer.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["vector_algebra", "temporal_one", "reciprocal_rank_fusion", "bm25_scores", "scan_running_state"])
def test_query_is_its_sql_at_the_next_size(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    test_query_is_its_sql(spark, con, folder, name)


@pytest.mark.parametrize("name", ["array_functions", "higher_order_functions"])
def test_halves_round_as_in_sql(spark, tmp_path, name):
    halves = [x for k in range(-60, 60) for x in ((k + 0.5) / 100, (k + 0.5) / 50)]
    for t in TABLES:
        if t != "embeddings":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    rows = [(i, halves[i : i + 64], 0) for i in range(0, len(halves) - 64, 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/out")
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    test_query_is_its_sql(spark, con, str(tmp_path), name)


@pytest.mark.parametrize("name", ["array_functions", "higher_order_functions"])
def test_array_columns_have_the_types_of_sql(spark, duck, folder, name):
    got = {c: re.sub(r"\bINT\b", "INTEGER", re.sub(r"^array<(.+)>$", r"\1[]", kind).upper()) for c, kind in registry.queries()[name](spark, folder).dtypes}
    assert got == {c: kind for c, kind, *_ in duck.execute(f"DESCRIBE {registry.oracle_sql()[name]}").fetchall()}


def test_higher_order_functions_of_no_items_and_nulls_are_as_in_sql(spark, tmp_path):
    odd = [[], None, [None], [None, None], [0.1, None, 0.3], [None, 0.2, -0.5], [-0.6, None], [0.05], [0.2, -0.2, 0.0, -0.0], [0.16], [-0.41]]
    spark.createDataFrame([(i, x, 0) for i, x in enumerate(odd)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/out")
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    test_query_is_its_sql(spark, con, str(tmp_path), "higher_order_functions")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, folder, name):
    assert registry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("braidwork/llm", "tests/llm"), ("braidwork/llm", "tests/llm", "corpus_pipeline.py")])
def test_library_stands_without_the_training_operators(tmp_path, gone):
    root = Path(__spark_entry__.__file__).parent
    for part in ("braidwork", "tests"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
    for part in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / part).exists():
            shutil.copy(root / part, tmp_path / part)
    for part in gone:
        where = tmp_path / part
        shutil.rmtree(where, ignore_errors=True) if where.suffix == "" else where.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert e.FLAGSHIP in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
