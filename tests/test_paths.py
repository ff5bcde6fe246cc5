import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusatlas.functions import paths

EXTENSIONS = {
    "a/.gitignore": "", "x.": ".", "a.b/c": "", "A.TS": ".TS", "..": "", "a/..": "", "...": ".",
    "a..": ".", "a/b.spec.ts": ".ts", "a/b.ts/": ".ts", "noext": "", "": "", "a.b/c.d": ".d",
}
NORMAL = {
    "/r/a/../b/./c": "/r/b/c", "/../x": "/x", "/a//b/": "/a/b", "/a/b": "/a/b", "/a/..b/c": "/a/..b/c",
    "/a/.b/c.": "/a/.b/c.", "/": "/", "/a/b/..": "/a", "/a/.": "/a", "/a/b/../../..": "/",
}


def test_extension(evaluate):
    assert evaluate(paths.extension, list(EXTENSIONS)) == list(EXTENSIONS.values())


def test_normalize(evaluate):
    assert evaluate(paths.normalize, list(NORMAL)) == list(NORMAL.values())


def test_base_and_dir(evaluate):
    values = ["a/b/c.ts", "c.ts", "/c.ts", "/a/b/", "/a//b", "/"]
    assert evaluate(paths.base_name, values) == ["c.ts", "c.ts", "c.ts", "b", "b", ""]
    assert evaluate(paths.dir_name, values) == ["a/b", ".", "/", "/a", "/a", "/"]


def test_resolve_prefers_absolute(spark):
    row = spark.range(1).select(
        paths.resolve(F.lit("/r/a"), F.lit("/x/y")).alias("a"),
        paths.resolve(F.lit("/r/a"), F.lit("../b")).alias("b"),
    ).first()
    assert tuple(row) == ("/x/y", "/r/b")


def test_ancestors(evaluate):
    assert evaluate(paths.ancestors, ["/a/b/c", "/a", "/"]) == [["/a", "/a/b"], [], []]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b.c", "..", ".", "", "..x"]), max_size=6), min_size=5, max_size=20))
def test_normalize_property(evaluate, parts):
    raw = ["/" + "/".join(p) for p in parts]
    once = evaluate(paths.normalize, raw)
    expected = [posixpath.normpath("/" + r.lstrip("/")) for r in raw]
    assert once == expected
    assert evaluate(paths.normalize, once) == once


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.lists(st.sampled_from(["a", "b.c", "..x"]), max_size=3),
            st.lists(st.sampled_from(["a", "..", ".", "", "b", "..."]), max_size=6),
        ),
        min_size=5, max_size=20,
    )
)
def test_from_folder_equals_resolve(spark, pairs):
    rows = [(i, "/" + "/".join(a), "/".join(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, folder string, path string").select(
        "i", paths.from_folder(F.col("folder"), F.col("path")).alias("fast"),
        paths.resolve(F.col("folder"), F.col("path")).alias("slow"),
    )
    assert [(r.i, r.fast) for r in df.collect()] == [(r.i, r.slow) for r in df.collect()]


@pytest.mark.parametrize("spec,base,expected", [("./x", "/r/s", "/r/s/x"), ("../../x", "/r/s", "/x")])
def test_resolve_relative(spark, spec, base, expected):
    assert spark.range(1).select(paths.resolve(F.lit(base), F.lit(spec))).first()[0] == expected
