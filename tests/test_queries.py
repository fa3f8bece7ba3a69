"""Registered queries against their SQL on the smallest tables; the entry module without the
training-data operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from statespan.plans import queries as plans
from statespan.sources import store

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_is_its_sql(spark, name):
    """Also leaves nothing in the shared folder once its result is there."""
    folder = store.Folder(spark, store.shared_folder(spark))
    before = folder.names()
    with store.scope():
        got = plans.queries()[name](spark, str(DATA)).toPandas()
    assert folder.names() == before
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(plans.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_every_query_has_sql(spark):
    assert set(plans.queries()) == set(plans.oracle_sql())
    assert entry.entry(spark).columns[:3] == ["wtm", "check", "state"]


def test_key_sums_do_not_overflow(spark):
    """Keys of the largest size, so many that their sum leaves 64 bits."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000).select((F.lit(123_263_644_654_232) - F.col("id")).alias("key"))
    total = rows.agg(F.sum(F.col("key").cast("decimal(38,0)")).alias("s")).first().s
    assert total == sum(123_263_644_654_232 - i for i in range(200_000)) > 1 << 63


@pytest.mark.parametrize("name", ["key_round_trip", "class_histogram", "mirror_pairs", "piece_counts"])
def test_no_nested_loops(spark, name):
    plan = plans.queries()[name](spark, str(DATA))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_entry_without_the_other_subpackage():
    code = ("import sys; sys.modules['statespan.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'delta_encode' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent, timeout=100)
