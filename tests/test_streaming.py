import datetime as dt

from pyspark.sql import functions as F

from corpusatlas.operators import enrich, telemetry
from corpusatlas.streaming.batches import enrich_new_files
from corpusatlas.streaming.usage import running_totals, usage_stream


def summaries(batch):
    files = batch.withColumn("repo", F.lit("r"))
    return enrich.outcome(enrich.refine(files)).select("path", "outcome", "summary")


def test_batches_commit_and_resume(spark, tmp_path):
    source, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    source.mkdir()

    def run():
        query = enrich_new_files(spark, str(source), str(out), mark, summaries, files_per_batch=3)
        query.awaitTermination()
        assert query.exception() is None
        return sorted(p.name for p in out.iterdir() if p.name.startswith("batch_id="))

    for i in range(7):
        (source / f"f{i}.ts").write_text(f"Sentence {i}. More.")
    assert run() == ["batch_id=0", "batch_id=1", "batch_id=2"]
    sizes = spark.read.parquet(str(out)).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in sizes} == {0: 3, 1: 3, 2: 1}
    assert run() == ["batch_id=0", "batch_id=1", "batch_id=2"]
    (source / "new.ts").write_text("New.")
    assert len(run()) == 4
    rows = spark.read.parquet(str(out))
    assert rows.count() == rows.select("path").distinct().count() == 8
    assert rows.where("outcome <> 'valid'").count() == 0


def test_replayed_batch_adds_no_rows(spark, tmp_path):
    """Take the last commit out of the checkpoint: the batch runs again and replaces its folder."""
    source, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    source.mkdir()
    for i in range(4):
        (source / f"f{i}.ts").write_text(f"Sentence {i}.")
    (source / "image.ts").write_bytes(b"\x89PNG\xff\xfe")

    def run():
        seen = []
        query = enrich_new_files(
            spark, str(source), str(out), str(mark),
            lambda batch: seen.append(1) or batch.select("path", "content", "read_ok"), files_per_batch=3,
        )
        query.awaitTermination()
        assert query.exception() is None
        return len(seen)

    assert run() == 2
    for name in ("1", ".1.crc"):
        (mark / "commits" / name).unlink(missing_ok=True)
    assert run() == 1
    rows = spark.read.parquet(str(out)).collect()
    assert len(rows) == 5
    assert [(r.content, r.read_ok) for r in rows if r.path.endswith("image.ts")] == [("", False)]


def test_running_totals_count_a_late_event(spark, tmp_path):
    schema = "run bigint, ts timestamp, kind string, completion_tokens bigint, prompt_tokens bigint, total_tokens bigint"
    new, late = dt.datetime(2024, 6, 1), dt.datetime(2020, 1, 1)
    for ts in (new, late):
        spark.createDataFrame([(1, ts, telemetry.MODEL_END, 2, 3, 5)], schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        running_totals(stream).writeStream.format("memory").queryName("late_totals").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("late_totals").select("run", "total_tokens", "n_ends").collect()] == [(1, 10, 2)]


def test_usage_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i % 5, i, start + dt.timedelta(hours=i), telemetry.MODEL_END if i % 3 else telemetry.CHAIN_END, i, 1, i + 1)
        for i in range(200)
    ]
    schema = (
        "run bigint, event_id bigint, ts timestamp, kind string, "
        "completion_tokens bigint, prompt_tokens bigint, total_tokens bigint"
    )
    events = spark.createDataFrame(rows, schema)
    # Files in time order; a final far event closes every earlier window.
    for day in range(9):
        events.where(F.dayofmonth("ts") == day + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame(
        [(9, 999, start + dt.timedelta(days=30), telemetry.MODEL_END, 0, 0, 0)], schema
    )
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        usage_stream(stream, delay="2 days")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "mark"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, telemetry.usage_by_window(events).collect()))
