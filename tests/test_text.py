import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusatlas.functions import text
from corpusatlas.operators import documents


def test_guard_at_the_limit(spark):
    rows = [("a b c",), ("a b c d",)]
    df = spark.createDataFrame(rows, "t string")
    guarded = text.size_guard(F.col("t"), text.token_count(F.col("t")), limit=3, cut=2)
    assert [r[0] for r in df.select(guarded).collect()] == ["a b c", "a "]


def test_tokens(evaluate):
    assert evaluate(text.token_count, ["", " a\tb\nc ", None, "x"]) == [0, 3, 0, 1]


def test_tiers(evaluate):
    assert evaluate(text.size_tier, [1999, 2000, 25999, 26000], "v bigint") == [
        "small", "middle", "middle", "large",
    ]


def test_escape(evaluate):
    assert evaluate(text.escape_braces, ["{a}", "{{", "x"]) == ["{{a}}", "{{{{", "x"]


def test_sentinel(evaluate):
    assert evaluate(text.or_sentinel, ["", None, "x"]) == [text.NOT_APPLICABLE] * 2 + ["x"]


def test_fill_does_not_fill_content_again(spark):
    column = text.fill("N {name}\nC {content}.", name=F.lit("{content}"), content=F.lit("{name}"))
    assert spark.range(1).select(column).first()[0] == "N {content}\nC {name}."


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(alphabet="ab \n\t\r", max_size=40), min_size=3, max_size=10),
    st.integers(1, 4),
)
def test_chunks_add_up(evaluate, texts, size):
    got = evaluate(lambda c: text.chunks(c, size), texts)
    for source, pieces in zip(texts, got):
        assert "".join(pieces) == source
        tokens = re.findall(r"[^ \n\t\r]+", source)
        again = [re.findall(r"[^ \n\t\r]+", p) for p in pieces]
        assert [t for p in again for t in p] == tokens
        assert all(len(p) == size for p in again[:-1])


def test_overlap(evaluate):
    assert evaluate(lambda c: text.chunks(c, 3, 1), ["a b c d e"]) == [["a b c ", "c d e", "e"]]
    with pytest.raises(ValueError):
        text.chunks(F.col("v"), 3, 3)


def test_documents_keep_metadata(spark):
    files = spark.createDataFrame([("/r/app", "a.ts", "one two three")], "repo string, path string, content string")
    rows = documents.from_files(files, size=2).collect()
    assert [r.chunk_no for r in rows] == [0, 1, 2]
    assert "".join(r.text for r in rows) == "file-path: a.ts\n\n    one two three\n    "
    assert all(
        r.metadata == {"repository": "app", "repositoryUrl": "/r/app", "source": "a.ts"} for r in rows
    )


def test_tiers_by_mode(spark):
    df = spark.createDataFrame([("openai-std",), ("azure-std",), ("gpt4turbo",), ("?",), (None,)], "mode string")
    got = [(r.model, r.large_context) for r in documents.with_tier(df).collect()]
    assert got == [
        ("gpt-4", False), ("gpt-4-32k", True), ("gpt-4-1106-preview", True),
        ("gpt-4-1106-preview", False), ("gpt-4-1106-preview", False),
    ]
