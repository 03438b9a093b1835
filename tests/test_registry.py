"""Every registered query against its SQL on the smallest tables, and the shape of a few plans."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rastrum.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem", "embeddings", "pages", "documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y) if all(not isinstance(v, (str, type(None))) for v in x) else repr(x) == repr(y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = entry.queries()
    p = plan(q["box_filter"](spark, SF))
    assert "Python" not in p and "Arrow" not in p
    assert "l_comment" not in p and "l_returnflag" not in p  # only the columns that boxes need are read
    assert "WindowGroupLimit" in plan(q["viz_top2_per_condition"](spark, SF))
    assert "Exchange" not in plan(q["frame_condition"](spark, SF))


@pytest.mark.parametrize("name", ["split_class_representation", "split_class_detail", "stratified_split", "camera_labels"])
def test_boxes_are_folded_once(spark, name):
    """Of the final plan, what reused exchanges stand for is not run again."""
    df = entry.queries()[name](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("Generate posexplode") == 1, final


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["condition", "n_frames", "pct"] and df.count() == 5
