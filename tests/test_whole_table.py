"""Queries that compare methods take the default fifth of their table as train, not a few rows of it."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_module


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(6)
    at = tmp_path_factory.mktemp("tables")
    part = {"p_partkey": np.arange(150), "p_size": rng.integers(1, 51, 150).astype("int32"), "p_retailprice": np.round(rng.uniform(900, 1100, 150), 2)}
    pq.write_table(pa.table(part), at / "part.parquet")
    return str(at)


def both(spark, folder, name):
    df = entry_module.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    got = [r.asDict() for r in df.collect()]
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(want)
    return got


def test_methods_are_compared_on_a_fifth_of_the_table(spark, folder):
    rows = {r["method"]: r["rows"] for r in both(spark, folder, "compare_methods")}
    assert rows["whole"] == rows["test_split"] == rows["train_split"] == 30
    assert 20 < rows["train_bags"] == rows["train_bags_test_split"] <= 30


def test_the_sweep_is_over_a_fifth_of_the_table(spark, folder):
    """With 30 train rows in one split five bags cover them; with two rows it would be four."""
    assert {r["s"] for r in both(spark, folder, "sweep")} == {3, 5}
