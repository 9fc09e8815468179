import os
import shutil
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_works_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q), set(o) - set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    if os.path.isdir(SF):
        code += f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
assert q['scan_count'](spark, {SF!r}).first()[0] > 0 and e.entry(spark).count() > 0"""
    env = os.environ | {"PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr


def rows(df):
    plain = lambda v: None if v is None or v != v or repr(v) == "<NA>" else v
    columns = sorted(df.columns)
    return columns, sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False))


def registered():
    sys.path.insert(0, ROOT)
    from tsumugi.plans.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", registered())
def test_query_equals_its_sql(spark, name):
    from tsumugi.plans.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = rows(QUERIES[name](spark, SF).toPandas())
    assert got == rows(db.execute(ORACLES[name]).df())
    assert got[1], "compares nothing"


def test_queries_without_sql(spark):
    """All candidates of all forms, against the search word by word."""
    from tsumugi.functions.deinflect import deinflect_word
    from tsumugi.plans.queries import DEINFLECTIONS, ORACLES, QUERIES

    assert set(QUERIES) - set(ORACLES) == {"deinflect_all"}
    want = [(r[0], k, c.word, c.kind, "/".join("+".join(x) for x in c.chains)) for r in DEINFLECTIONS for k, c in enumerate(deinflect_word(r[0]))]
    assert sorted(map(tuple, QUERIES["deinflect_all"](spark, SF).collect())) == sorted(want)
