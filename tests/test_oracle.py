"""Every query with an oracle: Spark result equals the DuckDB SQL (sf0.001)."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    import datetime
    import decimal
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def test_loads_from_a_zip_without_jars_twice(tmp_path):
    """``queries()`` and ``oracle_sql()`` need neither PySpark's own folder,
    nor a JVM, nor a session, and can be called and imported again."""
    import os
    import subprocess
    import sys
    import zipfile

    import pyspark
    top = os.path.dirname(pyspark.__file__)
    with zipfile.ZipFile(tmp_path / "pyspark.zip", "w") as z:
        for d, _, names in os.walk(top):
            if os.sep + "jars" in d:
                continue
            for n in names:
                if n.endswith((".py", ".json")):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    code = ("import sys, pyspark; assert 'pyspark.zip' in pyspark.__file__, pyspark.__file__\n"
            "import __spark_entry__ as e\n"
            "a = (set(e.queries()), set(e.oracle_sql()))\n"
            "for m in [m for m in sys.modules if m.startswith('tabsight.plans.catalog')]: del sys.modules[m]\n"
            "assert a == (set(e.queries()), set(e.oracle_sql())) and len(a[0]) >= 79\n"
            "assert all(isinstance(v, str) for v in e.oracle_sql().values())")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, PYTHONPATH=f"{tmp_path / 'pyspark.zip'}{os.pathsep}{repo}", JAVA_HOME="/nonexistent")
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=repo, timeout=120)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s_rows = sdf.collect()
    cur = duck.execute(SQL[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(sdf.columns, s_rows) == _rows(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"column", "z_outliers", "iqr_outliers"}
    assert df.count() >= 0
