"""Live pairing of unordered events against the batch operators."""

import datetime as dt
import json
import random

import pytest

from corpusatlas.operators import telemetry as T
from corpusatlas.streaming.durations import live_durations

SCHEMA = "run bigint, event_id bigint, ts timestamp, kind string"
START = dt.datetime(2024, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def play(spark, tmp_path, files, **options):
    """Each file is one micro-batch; the last one closes all earlier events."""
    source = tmp_path / "in"
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        live_durations(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert query.exception() is None
    return query, spark.read.parquet(str(tmp_path / "out")).collect()


def test_unordered_events_give_the_rows_of_the_batch(rocks, tmp_path):
    draw = random.Random(4)
    kinds = [T.CHAIN_START, T.MODEL_START, T.CHAIN_END, T.MODEL_END, T.RETRIEVER_START, T.RETRIEVER_END, "other"]
    rows = [(draw.randrange(4), i, START + dt.timedelta(seconds=37 * i, microseconds=i), draw.choice(kinds)) for i in range(160)]
    # Within every ten minutes or so, events arrive in any order.
    files = []
    for at in range(0, 160, 32):
        part = rows[at : at + 32]
        draw.shuffle(part)
        files += [part[:16], part[16:]]
    last = [(9, 999, START + dt.timedelta(days=3), T.CHAIN_START)]
    _, found = play(rocks, tmp_path, [*files, last, [(9, 1_000, START + dt.timedelta(days=9), T.CHAIN_START)]], delay="30 minutes")
    events = rocks.createDataFrame(rows, SCHEMA)
    chains = {(r.run, r.event_id): r.duration_sec for r in T.chain_durations(events).collect()}
    retrievers = {(r.run, r.event_id): r.duration_sec for r in T.retriever_durations(events).collect()}
    got = {(r.run, r.event_id): r.duration_sec for r in found}
    assert len(found) == len(got)
    assert got == chains | retrievers


def test_a_quiet_run_gives_its_state_up(rocks, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    files = [
        [(1, 1, at(0), T.CHAIN_START), (2, 2, at(0), T.CHAIN_START)],
        [(1, 3, at(1), T.CHAIN_END)],
        [(2, 4, at(40), T.CHAIN_START)],
        [(1, 5, at(41), T.CHAIN_END), (2, 6, at(42), T.CHAIN_END)],
        [(3, 7, at(300), T.CHAIN_START)],
        [(3, 8, at(600), T.CHAIN_START)],
    ]
    query, found = play(rocks, tmp_path, files, delay="1 hour", idle_seconds=10 * 3_600)
    assert {r.event_id: r.duration_sec for r in found} == {3: 3_600.0, 5: None, 6: 7_200.0}
    steps = [json.loads(p.json) for p in query.recentProgress]
    held = [s["stateOperators"][0]["numRowsTotal"] for s in steps if s["stateOperators"]]
    assert held[-1] < max(held)
