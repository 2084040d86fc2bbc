"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
import glob
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from millwright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        name = p.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    frame = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        assert frame.count() > 0
        return
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = Counter(tuple(map(plain, r)) for r in want.fetchall())
    assert Counter(tuple(map(plain, r)) for r in frame.select(columns).collect()) == expected


ORDERS = {
    "no such order": [(1, 7, "O"), (2, 7, "P"), (3, 8, "F")],
    "two": [(5, 7, "F"), (4, 7, "F"), (1, 7, "O")],
    "a null key": [(None, 7, "F"), (6, 7, "F"), (None, None, None)],
    "none at all": [],
}


@pytest.mark.parametrize("case", sorted(ORDERS))
def test_point_lookup(spark, tmp_path, case):
    spark.createDataFrame(ORDERS[case], "o_orderkey long, o_custkey long, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["point_lookup"]).fetchall()
    assert list(map(tuple, catalog.queries()["point_lookup"](spark, str(tmp_path)).collect())) == want


def test_point_lookup_falls_back(spark):
    """The operator goes on to the next frame only where those before have no row."""
    from millwright.operators import match

    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id long, kind string")
    first = lambda *kinds: [r["id"] for r in match.point_lookup([(rows, rows["kind"] == k) for k in kinds], ["id"]).collect()]
    assert (first("a", "b"), first("x", "b"), first("x", "y")) == ([2], [1], [])


@pytest.mark.parametrize("name", ["bm25_search", "stored_search"])
def test_search_of_null_texts(spark, tmp_path, name):
    """A null text counts as a document, an empty one also in the mean length."""
    texts = [None, "", "the license", None, "The License of the work, the whole of it", "the work", None, "no such word"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    assert len(want) == 2 and sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect())) == want


def test_entry_survives_without_the_training_data_part():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    hide = "import sys; sys.modules['millwright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60; assert not any(q.startswith('op') for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", hide], cwd=root, check=True, timeout=120)
