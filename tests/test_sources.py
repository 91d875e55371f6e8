import pytest
from pyspark.sql import functions as F

from reweight.operators.split import Split
from reweight.sources import tables as W
from reweight.sources import text as X

ARFF = """% comment
@relation r
@attribute a numeric
@attribute b numeric
@attribute c {x,y}

@Data
1, 2.5 ,x

3,4,y
5,-6e1,x
"""


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text(ARFF)
    rows = X.read_arff(spark, str(tmp_path / "a.arff")).orderBy("row_id").collect()
    assert [(r["features"], r["label"]) for r in rows] == [([1, 2.5], "x"), ([3, 4], "y"), ([5, -60], "x")]
    first = X.read_arff(spark, str(tmp_path / "a.arff"), 2).orderBy("row_id").collect()
    assert [r["label"] for r in first] == ["x", "y"]


def test_arff_missing_value_raises(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@data\n1,?,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        X.read_arff(spark, str(tmp_path / "a.arff")).collect()


def test_arff_without_data_is_empty(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@relation r\n1,2,x\n")
    assert X.read_arff(spark, str(tmp_path / "a.arff")).count() == 0


def test_line_ids_follow_the_file_over_many_splits(spark, tmp_path):
    want = [f"{i % 7},{i},k" for i in range(3000)]
    (tmp_path / "a.arff").write_text("@data\n" + "\n".join(want) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = X.read_arff(spark, str(tmp_path / "a.arff"))
        got = rows.select("row_id", F.get("features", F.lit(1)).alias("v")).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["v"] for r in got] == list(range(3000))
    assert len({r["row_id"] for r in got}) == 3000


def test_folder_is_read_in_file_order(spark, tmp_path):
    for n in (2, 0, 1):
        (tmp_path / f"part {n}.arff").write_text("@data\n" + "".join(f"{n * 10 + i},k\n" for i in range(4)))
    got = X.read_arff(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["features"][0] for r in got] == [0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]


def test_sparse(spark, tmp_path):
    (tmp_path / "s.data").write_text("b 1:0.5 4:2\n\na 2:1\nb\n")
    rows = X.read_sparse(spark, str(tmp_path / "s.data"))
    assert X.sparse_width(rows).first()["width"] == 4
    dense = X.encode_label(X.to_dense(rows)).orderBy("row_id").collect()
    assert [(r["features"], r["label_code"]) for r in dense] == [
        ([0.5, 0, 0, 2], 0.0),
        ([0, 1, 0, 0], 1.0),
        ([0, 0, 0, 0], 0.0),
    ]


def test_round_trips(spark, points, tmp_path):
    df = points([[1.0], [2.0], [3.0]])
    cut = Split(df.where("row_id = 0").withColumn("true_beta", F.lit(1.5)), df.where("row_id > 0"), 1, 2)
    W.write_split(cut, str(tmp_path / "split"))
    back = W.read_split(spark, str(tmp_path / "split"))
    assert (back.train_rows, back.test_rows) == (1, 2)
    assert back.train.first()["true_beta"] == 1.5
    assert W.write_column(cut.train, "true_beta", str(tmp_path / "beta"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "beta")).collect()] == ["1.5"]
    assert not W.write_column(cut.train.limit(0), "true_beta", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_a_run_that_is_appended_again_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "method string, nmse double")
    folder = str(tmp_path / "report")
    read = lambda: sorted(map(tuple, W.read_report(spark, folder, "method string, nmse double").collect()))
    assert read() == []
    for run in ("r-1", "r-1", "007"):
        W.append_report(df, folder, run)
    assert read() == [("a", 1.5, "007"), ("a", 1.5, "r-1")]
    # An append that broke off has no marker and is not read.
    (tmp_path / "report" / "run=r-1" / "_SUCCESS").unlink()
    assert read() == [("a", 1.5, "007")]
    with pytest.raises(ValueError, match="named by"):
        W.append_report(df, folder, "a/b")
