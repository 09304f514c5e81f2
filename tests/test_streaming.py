import pytest

from weftgraph.streaming import incremental


def test_changes(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "x", ""), ("c", "x", "y"), ("d", "1", "2")], "id string, p string, q string")
    new = spark.createDataFrame([("a", "x", ""), ("b", "x", ""), ("d", "12", ""), ("e", None, None)], "id string, p string, q string")
    assert {tuple(r) for r in incremental.changes(old, new, "id").collect()} == {("a", "changed"), ("c", "removed"), ("d", "changed"), ("e", "added")}


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "id string, body string, loaded_at long"
    src, root, check = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check")

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.keep_current(stream, root, check).awaitTermination(120)
        return {tuple(r) for r in incremental.current(spark, root).collect()}

    assert incremental.current(spark, root) is None
    assert deliver([("a", "1", 1), ("a", "2", 2), ("b", "1", 5)]) == {("a", "2", 2), ("b", "1", 5)}
    assert deliver([("b", "0", 4), ("c", "1", 1), ("a", "3", 3)]) == {("a", "3", 3), ("b", "1", 5), ("c", "1", 1)}


SCHEMA = "id string, body string, loaded_at long"


def feed(spark, src, root, check, rows, **kw):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    incremental.keep_current(spark.readStream.schema(SCHEMA).parquet(src), root, check, **kw).awaitTermination(120)


def test_state_under_a_uri_is_folded_not_replaced(spark, tmp_path):
    src, root, check = str(tmp_path / "in"), f"file://{tmp_path}/state", str(tmp_path / "check")
    for n, rows in enumerate([[("a", "1", 1)], [("b", "1", 1)], [("a", "0", 0), ("c", "1", None)], [("c", "2", 1)]]):
        feed(spark, src, root, check, rows, buckets=4)
    assert {tuple(r) for r in incremental.current(spark, root).collect()} == {("a", "1", 1), ("b", "1", 1), ("c", "2", 1)}
    # the last two versions stay, and of the data what they list
    assert [p.name for p in sorted((tmp_path / "state" / "versions").glob("[0-9]*"))] == ["2.json", "3.json"]
    listed = {p for n in (2, 3) for p in incremental._manifest(spark, root, n)["buckets"].values()}
    assert {f"data/{p.parent.name}/{p.name}" for p in (tmp_path / "state" / "data").glob("*/_bucket=*")} == listed


def test_a_missing_version_is_an_error(spark, tmp_path):
    src, root, check = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check")
    feed(spark, src, root, check, [("a", "1", 1)])
    (tmp_path / "state" / "versions" / "0.json").unlink()
    with pytest.raises(Exception, match="missing"):
        feed(spark, src, root, check, [("b", "1", 1)])


def test_latest_with_nulls_and_ties(spark):
    rows = [("a", "x", None), ("b", "x", None), ("b", "y", 1), ("c", "p", 3), ("c", "q", 3), (None, "n", 1)]
    got = [sorted((str(r["id"]), r["body"], r["loaded_at"]) for r in incremental.latest(spark.createDataFrame(x, SCHEMA).repartition(3), "id", "loaded_at").collect()) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and got[0][:2] == [("None", "n", 1), ("a", "x", None)] and ("b", "y", 1) in got[0] and len(got[0]) == 4
    assert incremental.latest(spark.createDataFrame([], SCHEMA), "id", "loaded_at").count() == 0
