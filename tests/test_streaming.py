from pyspark.sql import functions as F

from loamgraph.streaming.upserts import ParquetTable, group_summary_stream, session_stream, statement_stream, upsert_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def feed(spark, folder, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in{i}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")


def test_upserts_by_id_and_replay(spark, tmp_path):
    schema = "_id string, v string, at bigint"
    feed(spark, tmp_path, [[("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], [("a", "3", 3), ("c", "1", 1)]], schema)
    target = ParquetTable(spark, str(tmp_path / "table"), schema)
    for _ in range(2):
        upsert_stream(source(spark, tmp_path, schema), target, str(tmp_path / "cp"), "at").awaitTermination()
        assert rows(target.read()) == [("a", "3", 3), ("b", "1", 1), ("c", "1", 1)]
    assert not target.write(target.read(), 0)
    assert ParquetTable(spark, str(tmp_path / 'none'), schema).read().count() == 0


def test_statements_keep_their_first_time(spark, tmp_path):
    schema = "_id string, subject string, when_ms bigint"
    feed(spark, tmp_path, [[("s1", "x", 1)], [("s1", "x", 9), ("s2", "y", 9)]], schema)
    target = ParquetTable(spark, str(tmp_path / "table"), schema)
    statement_stream(source(spark, tmp_path, schema), target, str(tmp_path / "cp")).awaitTermination()
    assert rows(target.read()) == [("s1", "x", 1), ("s2", "y", 9)]


def test_summary_and_sessions(spark, tmp_path):
    schema = "g string, t bigint, c string"
    hour = 3_600_000
    feed(spark, tmp_path, [[("a", 0, "x"), ("a", hour, "y"), ("b", 5, "x")], [("a", 10 * hour, "x"), ("a", 11 * hour, "x")], [("a", 30 * hour, "z"), ("a", None, "z")]], schema)
    out = group_summary_stream(source(spark, tmp_path, schema), "g", "t", "c")
    q = out.writeStream.outputMode("complete").format("memory").queryName("summary").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp1")).start()
    q.awaitTermination()
    got = spark.table("summary").where("window is not null").groupBy("group_id").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in got} == {"a": 5, "b": 1}
    q = session_stream(source(spark, tmp_path, schema), "g", "t", 6 * hour).writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert rows(spark.table("sessions")) == [("a", 0, hour, 2), ("a", 10 * hour, 11 * hour, 2), ("b", 5, 5, 1)]


def test_sessions_with_late_rows(spark, tmp_path):
    schema = "g string, t bigint"
    hour = 3_600_000
    feed(spark, tmp_path, [[("a", 100 * hour)], [("a", 10 * hour), ("a", 97 * hour), ("b", 3 * hour)], [("a", 91 * hour), ("c", 400 * hour)], [("d", 410 * hour)], [("c", 900 * hour), ("b", 2 * hour)]], schema)
    q = session_stream(source(spark, tmp_path, schema), "g", "t", 6 * hour, "150 hours").writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    # The row of b at 2 h is later than the watermark; 91 h and 100 h are bridged by 97 h.
    assert rows(spark.table("late")) == sorted([("a", 10 * hour, 10 * hour, 1), ("a", 91 * hour, 100 * hour, 3), ("b", 3 * hour, 3 * hour, 1), ("c", 400 * hour, 400 * hour, 1), ("d", 410 * hour, 410 * hour, 1)], key=str)


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    schema = "_id string, v bigint"
    target = ParquetTable(spark, str(tmp_path / "table"), schema, buckets=8)
    for n in range(4):
        assert target.write(spark.createDataFrame([(f"k{i}", n) for i in range(40 if n == 0 else 1)], schema), n, lambda old, new: old.join(new, "_id", "left_anti").unionByName(new))
    assert rows(target.read()) == sorted([("k0", 3)] + [(f"k{i}", 0) for i in range(1, 40)], key=str)
    assert len(set(target._manifest()["parts"].values())) == len(target._manifest()["parts"]) and len({p.split("/")[0] for p in target._manifest()["parts"].values()}) == 2
    assert not target.write(target.read(), 3)
    kept = {n for n in target.files.names(target.root) if n.startswith("v")}
    assert kept == {"v000000000001", "v000000000003", "v000000000004"}  # the first, for its other buckets, and two versions
