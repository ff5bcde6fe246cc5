import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusatlas.functions import answers
from corpusatlas.operators import enrich

OK = {"fileDescription": "d", "tag": "ui"}
CASES = [
    (json.dumps(OK), []),
    (json.dumps({**OK, "elementsDetail": [1, {"a": 2}], "extra": 1}), []),
    (json.dumps({**OK, "algorithmicLogic": {"description": "d", "rationale": "r"}}), []),
    (json.dumps({**OK, "algorithmicLogic": {"description": "d"}}), ["algorithmicLogic.rationale"]),
    (json.dumps({**OK, "businessLogic": None}), ["businessLogic.rules", "businessLogic.workflows"]),
    (json.dumps({**OK, "businessLogic": {"rules": 1, "workflows": "w"}}), ["businessLogic.rules"]),
    (json.dumps({**OK, "flowDescription": {"initialization": "i", "processingSteps": []}}), []),
    (
        json.dumps({**OK, "flowDescription": {"initialization": "i", "processingSteps": ["a", 1]}}),
        ["flowDescription.processingSteps"],
    ),
    (
        json.dumps({**OK, "flowDescription": {"initialization": "i", "processingSteps": [None]}}),
        ["flowDescription.processingSteps"],
    ),
    (json.dumps({"tag": "ui"}), ["fileDescription"]),
    (json.dumps({"fileDescription": 5, "tag": "ui"}), ["fileDescription"]),
    (json.dumps({"fileDescription": "d", "tag": "UI"}), ["tag"]),
    (json.dumps({"fileDescription": "d", "tag": None}), ["tag"]),
    ("[1]", ["object"]),
    ("null", ["object"]),
    ("{", ["json"]),
    ("", ["json"]),
    (None, ["json"]),
]


def test_errors(evaluate):
    assert evaluate(answers.errors, [c for c, _ in CASES]) == [e for _, e in CASES]


def test_outcome(spark):
    good = json.dumps(OK)
    rows = [
        (0, good), (1, f"```json\n{good}\n```"), (2, f"Here it is: {good} done"),
        (3, "no braces"), (4, "```{\"tag\": \"ui\"}```"), (5, None),
    ]
    df = spark.createDataFrame(rows, "i int, answer string")
    table = enrich.outcome(df)
    got = {r.i: (r.outcome, r.summary, r.reason) for r in table.collect()}
    assert got[0] == ("valid", good, None)
    assert got[1] == got[2] == ("repaired", good, None)
    assert got[3] == got[5] == ("quarantine", None, "json")
    assert got[4] == ("quarantine", None, "fileDescription")
    accepted, refused = enrich.split_outcome(table)
    assert accepted.count() == 3 and refused.count() == 3
    assert "reason" not in accepted.columns and "summary" not in refused.columns


def test_tolerant(evaluate):
    got = evaluate(lambda c: F.to_json(answers.tolerant(c)), ['{"a": [1, 2]}', "{", "5", ""])
    assert got == ['{"a":[1,2]}', "{}", "5", "{}"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [("/r", f"a{i}.ts", f"First {i}. Second! Third? Fourth") for i in range(6)]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def test_default_passes(files):
    rows = {r.path: r for r in enrich.refine(files).collect()}
    answer = json.loads(rows["a1.ts"].answer)
    assert answer["fileDescription"] == "First 1. Second! Third?"
    assert answer["tag"] == "feature"
    assert answer["elementsDetail"] == {
        "tokens": 5, "sentences": 4, "verification": "yes, in 30 characters",
        "digest": hashlib.sha256(b"First 1. Second! Third? Fourth").hexdigest(),
    }
    assert rows["a1.ts"].questions == "Does the file say: First 1."


def test_default_passes_stay_in_the_jvm(files):
    plan = enrich.refine(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_model_passes(files):
    def model(rows: pd.DataFrame, step: str, n: int):
        if step == "summary" and (rows.path == "a3.ts").any():
            raise RuntimeError("one file fails")
        return [
            f"{step}{n}<{a}|{q}|{x}>" for a, q, x in zip(rows.answer, rows.questions, rows.answers)
        ]

    rows = {r.path: r for r in enrich.refine(files, passes=2, model=model).collect()}
    first = "summary0<None|None|None>"
    asked = f"questions0<{first}|None|None>"
    told = f"answers0<{first}|{asked}|None>"
    assert rows["a0.ts"].answer == f"summary1<{first}|{asked}|{told}>"
    assert rows["a3.ts"].answer is None and len(rows) == 6
    kinds = enrich.outcome(enrich.refine(files, passes=1, model=model)).where("path = 'a3.ts'")
    assert [r.reason for r in kinds.collect()] == ["json"]


def test_upsert_is_idempotent(spark):
    schema = "repo string, path string, summary string, batch_id int"
    old = spark.createDataFrame([("r", "a", "1", 0), ("r", "b", "1", 0)], schema)
    new = spark.createDataFrame([("r", "a", "2", 1), ("r", "c", "2", 1)], schema)
    once = enrich.upsert(old, new, ["repo", "path"])
    twice = enrich.upsert(once, new, ["repo", "path"])
    expected = [("r", "a", "2", 1), ("r", "b", "1", 0), ("r", "c", "2", 1)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == expected


def test_batches(spark):
    rows = [("r", f"{i:04}") for i in range(120)] + [("s", "x")]
    df = spark.createDataFrame(rows, "repo string, path string")
    for bounds in ({}, {"at_most": 121}, {"at_most": 121, "rows_per_task": 10}):
        got = {(r.repo, r.path): r.batch_no for r in enrich.assign_batches(df, **bounds).collect()}
        assert got["r", "0049"] == 0 and got["r", "0050"] == 1 and got["r", "0119"] == 2
        assert got["s", "x"] == 0 and len(got) == 121


def test_tags(evaluate):
    paths = ["a.html", "a.scss", "a.yml", "x/index.ts", "a.ts"]
    assert evaluate(enrich.tag_by_rule, paths) == ["ui", "ui", "dataAccess", "utility", "feature"]
