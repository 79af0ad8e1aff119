"""Registration, and the queries that SQL can express against their SQL."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from wearcast.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = [n for n in E.queries() if n[:2] == "op" and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = E.queries()[name](spark, SF)
    want = con.execute(Q.ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(E.__file__))
    for part in ("__spark_entry__.py", "wearcast"):
        os.symlink(f"{root}/{part}", tmp_path / part) if part.endswith(".py") else os.mkdir(tmp_path / part)
    for part in os.listdir(f"{root}/wearcast"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{root}/wearcast/{part}", tmp_path / "wearcast" / part)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import os; os.chdir({str(tmp_path)!r}); exec(open('__spark_entry__.py').read(), {{'__name__': 'e', '__file__': {str(tmp_path / '__spark_entry__.py')!r}}}); import wearcast; print(wearcast.__path__)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert out.returncode == 0, out.stderr[-500:]
    assert str(tmp_path) in out.stdout
