"""The driver entry: names line up, and cheap queries equal their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
FAST = ["row_index", "mean_vector", "accept_prob", "biased_split", "partition_bags", "random_pairs", "mean_weights", "bagged_kmm_2", "append_report_runs", "kernel_width_sampled", "kappa_sparse"]


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_flagship(spark):
    rows = entry_module.entry(spark)
    assert set(rows.columns) == {"row_id", "beta", "true_beta"}
    assert rows.count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry_module.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["test_split_weights_table", "test_ensemble_kmm_table", "run_stats_whole_table", "run_stats_test_ensemble_table", "compare_methods_table", "bagged_kmm_2_table", "bagged_kmm_3_table", "bagged_kmm_4_table"])
def test_whole_train_tables(spark, name):
    """A fifth of part as train; without SQL, so bounds and counts."""
    rows = [r.asDict() for r in entry_module.queries()[name](spark, FOLDER).collect()]
    n = spark.read.parquet(f"{FOLDER}/part.parquet").count() // 5
    assert rows
    for r in rows:
        assert all(v for v in r.values()) and r.get("n", n) == r.get("ids", n) == r.get("train_rows", n) == n


def test_the_rest_works_where_a_library_of_the_training_data_part_is_missing():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
sys.modules["xxhash"] = None
import __spark_entry__ as e
names = e.queries()
assert "biased_split" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
