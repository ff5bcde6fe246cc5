import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusatlas.operators import conversations as c
from corpusatlas.operators import telemetry as t


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "system", "S"), (1, 1, "user", "a"), (1, 5, "assistant", "b"), (1, 7, "user", "c"),
        (2, 0, "assistant", "x"), (2, 1, "assistant", "y"),
        (3, 0, "system", ""), (4, 0, "system", "only"),
    ]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_save_and_load(turns):
    messages = c.saved_messages(turns)
    assert sorted(map(tuple, messages.collect())) == [
        (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y"),
    ]
    loaded = sorted(map(tuple, c.loaded(messages, c.system_messages(turns)).collect()))
    assert loaded == [
        (1, -1, "system", "S"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
        (2, 0, "user", "x"), (2, 1, "assistant", "y"),  # roles go by place
        (4, -1, "system", "only"),
    ]


def test_system_argument(turns):
    assert {r.system_message for r in c.system_messages(turns, "given").collect()} == {"given"}
    assert {r.conv_id: r.system_message for r in c.system_messages(turns, "").collect()} == {
        1: "S", 2: None, 3: "", 4: "only",
    }


def test_has_history(spark, turns):
    assert {r.conv_id: r.has_history for r in c.has_history(turns).collect()} == {
        1: True, 2: True, 3: False, 4: True,
    }
    texts = ['{"chatMessages": ["a"]}', '{"chatMessages": [], "systemMessage": "s"}', "{}", "{bad", '{"chatMessages": []}']
    saved = spark.createDataFrame([(x,) for x in texts], "value string")
    assert [r.has_history for r in c.saved_file_has_history(saved).collect()] == [True, True, False, False, False]


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


EVENTS = [
    (1, 1, 0, t.MODEL_START), (1, 2, 1, t.MODEL_START), (1, 3, 3, t.MODEL_END),  # first model start
    (1, 4, 4, t.CHAIN_START), (1, 5, 5, t.CHAIN_START), (1, 6, 6, t.MODEL_START),
    (1, 7, 8.5, t.CHAIN_END),  # two starts, then an end: the later one
    (1, 8, 9, t.MODEL_END), (2, 9, 1, t.CHAIN_END), (2, 10, 2, t.MODEL_START), (2, 11, 2, t.MODEL_END),
    (1, 12, 1, t.RETRIEVER_START), (1, 13, 2, t.RETRIEVER_END), (1, 14, 3, t.RETRIEVER_END),
    (2, 15, 3, t.RETRIEVER_END),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(r, e, at(s), k, e, None if e == 8 else 1, 1) for r, e, s, k in EVENTS]
    schema = (
        "run bigint, event_id bigint, ts timestamp_ntz, kind string, "
        "completion_tokens bigint, prompt_tokens bigint, total_tokens bigint"
    )
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("bounds", [{}, {"at_most": 15}, {"at_most": 15, "rows_per_task": 2}])
def test_durations(events, bounds):
    chain = {r.event_id: r.duration_sec for r in t.chain_durations(events, **bounds).collect()}
    assert chain == {3: 3.0, 7: 3.5, 8: 4.0, 9: None, 11: 0.0}
    found = {r.event_id: r.duration_sec for r in t.retriever_durations(events, **bounds).collect()}
    assert found == {13: 1.0, 14: 2.0, 15: None}


def test_totals(events):
    got = {r.run: tuple(r)[1:] for r in t.usage_totals(events).collect()}
    assert got == {1: (11, 1, 2), 2: (11, 1, 1)}


def test_log_lines(spark):
    df = spark.createDataFrame([(at(1.5), "info", "a: b\nc")], "ts timestamp_ntz, level string, m string")
    line = t.log_line(F.col("ts"), F.col("level"), F.col("m"))
    row = df.select(line.alias("line")).select("line", *(v.alias(k) for k, v in t.parse_log_line(F.col("line")).items())).first()
    assert tuple(row) == ("2024-01-01T00:00:01.500Z info: a: b\nc", "2024-01-01T00:00:01.500Z", "info", "a: b\nc")
