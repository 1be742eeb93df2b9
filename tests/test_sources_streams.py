import json

import re

from pyspark.sql import functions as F

from quirework.operators import jobs as jb
from quirework.operators import review as rv
from quirework.sources import files as fl
from quirework.streaming import stateful as st


def test_json_sources_skip_corrupt_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"job_id": "1", "upload_id": "u", "status": "queued", "created_at": "2024-01-01", "pipeline": [{"agent": "A", "status": "pending"}]}))
    (tmp_path / "b.json").write_text("{ not json")
    (tmp_path / "c.json").write_text(json.dumps({"job_id": "2", "upload_id": "u", "status": "failed", "created_at": "2024-01-03"}, indent=1))
    assert [r.job_id for r in fl.read_jobs(spark, str(tmp_path)).collect()] == ["2", "1"]


def test_upload_screen_on_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    df = fl.read_binary(spark, str(tmp_path)).withColumns(
        {"file_name": F.element_at(F.split("path", "/"), -1), "mime_type": F.lit("application/pdf")})
    got = {r.file_name: r.reject_reason for r in fl.screen_uploads(df).collect()}
    assert got == {"a.pdf": None, "b.pdf": "SIGNATURE", "c.txt": "EXTENSION"}


def test_tables_are_bucketed_and_append_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    fl.write_table(df, str(tmp_path / "t"), buckets=8)
    one = fl.read_table(spark, str(tmp_path / "t"), 7, buckets=8)
    assert [r.text for r in one.collect()] == ["t7"]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    first = fl.append_only(df, None, str(tmp_path / "a"), ["doc_id"])
    more = fl.append_only(df.withColumn("text", F.lit("new")), spark.read.parquet(str(tmp_path / "a")), str(tmp_path / "a"), ["doc_id"])
    assert first is not None and spark.read.parquet(str(tmp_path / "a")).where("text = 'new'").count() == 0 and more is not None


def test_page_cache(spark):
    p = spark.createDataFrame([(1, b"a", "r"), (2, b"a", "r"), (3, b"b", "r")], "page int, content binary, rect string")
    cache = fl.page_hash(p.where("page = 3")).select("page_hash", F.lit("done").alias("blocks"))
    work, hit = fl.page_work(p, cache)
    assert work.count() == 1 and [r.page for r in hit.collect()] == [3]


def test_replay_stream_equals_batch(spark, tmp_path):
    rows = [("%03d" % i, i % 3, float(i), (i * 7) % 5) for i in range(60)]
    df = spark.createDataFrame([(d, o, t, r) for o, d, t, r in rows], "doc_id long, override_id string, created_at double, expected_version long")
    for k in range(3):
        df.where(F.floor(F.col("created_at") / 20) == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    want = {(r.doc_id, r.override_id) for r in rv.replay_actions(df.withColumn("ord", F.struct("created_at", "override_id"))).where("accepted").collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = st.replay_stream(stream).writeStream.format("memory").queryName("replayed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.doc_id, r.override_id) for r in spark.sql("SELECT * FROM replayed WHERE accepted").collect()} == want


def test_latest_job_stream(spark, tmp_path):
    ev = spark.createDataFrame([("a", 1, "queued", 1.0), ("a", 2, "failed", 2.0), ("b", 3, "queued", 1.0)], "job_id string, event_id int, status string, updated_at double")
    ev.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = st.latest_job_stream(s).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.job_id, r.status) for r in spark.sql("SELECT * FROM latest").collect()} == {("a", "failed"), ("b", "queued")}
    t = ev.withColumn("updated_at", F.timestamp_seconds("updated_at"))
    assert {(r.job_id, r.status) for r in jb.latest(t).collect()} == {("a", "failed"), ("b", "queued")}


def test_every_query_has_an_oracle():
    import __spark_entry__ as e

    own = {q for q in e.queries() if q != "pipeline" and not re.match(r"op[0-9]+_", q)}
    assert own and own <= set(e.oracle_sql())
