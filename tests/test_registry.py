"""Every registered query with SQL against that SQL, over small tables made here."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from annulus.plans import registry

@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, r = tmp_path_factory.mktemp("tables"), np.random.default_rng(4)
    rows = r.normal(size=(450, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    spark.createDataFrame([(i, x.astype(float).tolist(), int(i % 10)) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    line = [(int(i // 5), int(r.integers(5)), int(i % 5 + 1), float(r.integers(1, 50)), round(float(r.uniform(900, 90000)), 2), int(r.integers(0, 11)) / 100, int(r.integers(0, 9)) / 100, "ANR"[r.integers(3)], "FO"[r.integers(2)]) for i in range(3000)]
    spark.createDataFrame(line, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(i, "abc"[i % 3], i / 7) for i in range(50)], "event_id long, event_type string, value double").write.parquet(f"{root}/events.parquet")
    c = duckdb.connect()
    for t in ("embeddings", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet/*.parquet'")
    return str(root), c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, tables, name):
    root, c = tables
    df = registry.QUERIES[name](spark, root)
    columns = sorted(df.columns)
    expected = c.execute(registry.ORACLE_SQL[name]).fetchall()
    order = [[d[0] for d in c.description].index(x) for x in columns]
    key = lambda r: repr(r)
    got = sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=key)
    want = sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in (r[i] for i in order)) for r in expected), key=key)
    assert got == want


def test_wide_search_finds_nine_in_ten(spark, tables):
    assert registry.QUERIES["recall_wide"](spark, tables[0]).first().recall >= 0.9


def test_others_give_rows(spark, tables):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, tables[0]).count() > 0


def test_entry_points():
    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
