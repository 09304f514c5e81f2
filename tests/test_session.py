from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftgraph import files, session


def fake(master, named=None, given=None):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named}, getCheckpointDir=lambda: given))


def test_no_folder_of_one_machine_on_a_cluster():
    assert session.shared_dir(fake("spark://host:7077", "hdfs://store/cuts/")) == "hdfs://store/cuts"
    assert session.shared_dir(fake("yarn", None, "hdfs://store/cuts")) == "hdfs://store/cuts"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
    assert session.shared_dir(fake("local[4]"))


def test_scope_removes_what_was_cut_inside(spark):
    outer = session.write_cut(spark.range(3).toDF("x"))
    with session.scope(spark):
        inner = session.write_cut(spark.range(3).toDF("x"))
        assert files.exists(spark, inner)
    assert not files.exists(spark, inner) and files.exists(spark, outer)
    session.drop_cut(spark, outer)


def test_cuts_hold_no_shuffle_files_and_leave_the_setting(spark):
    before = spark.conf.get(session._CLEAN, None)
    d = session.cut(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert d.count() == 10 and spark.conf.get(session._CLEAN, None) == before


def test_joined_files(spark, tmp_path):
    for i, text in enumerate([",a\n", "", ",b\n"]):
        (tmp_path / "parts").mkdir(exist_ok=True)
        (tmp_path / "parts" / f"part-{i}").write_text(text)
    files.join_files(spark, f"file://{tmp_path}/out", [b"[", (f"{tmp_path}/parts", 1), b"]", (f"{tmp_path}/none", 0)])
    assert (tmp_path / "out").read_text() == "[a\n,b\n]"
    files.write_text(spark, str(tmp_path / "x" / "y"), "é")
    assert files.read_text(spark, str(tmp_path / "x" / "y")) == "é" and files.names_in(spark, str(tmp_path / "x")) == ["y"]
    assert files.stamp(spark, str(tmp_path / "nix")) is None and not files.is_file(spark, str(tmp_path / "x"))
