import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusatlas import session
from corpusatlas.sources import catalogue, files


def test_catalogues_by_name(spark, tmp_path):
    for name in ("ast-one.json", "ast-two.json", "other.json", "ast-three.txt"):
        (tmp_path / name).write_text(json.dumps({"files": [name]}, indent=2))
    rows = catalogue.read_catalogues(spark, str(tmp_path), "files array<string>").collect()
    assert sorted(r.files[0] for r in rows) == ["ast-one.json", "ast-two.json"]


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_catalogue_modes(spark, tmp_path, form):
    # Two repositories with one base name do not overwrite each other.
    schema = "repository string, fileName string"
    first = spark.createDataFrame([("/a/app", "x"), ("/b/app", "y")], schema)
    second = spark.createDataFrame([("/a/app", "z")], schema)
    out = str(tmp_path / "store")

    def names():
        return sorted(r.fileName for r in spark.read.schema(schema).format(form).load(out).collect())

    catalogue.write_catalogue(first, out, form=form)
    assert names() == ["x", "y"]
    catalogue.write_catalogue(second, out, if_exists="skip", form=form)
    assert names() == ["x", "y"]
    with pytest.raises(AnalysisException):
        catalogue.write_catalogue(second, out, form=form)
    catalogue.write_catalogue(second, out, if_exists="rebuild", form=form)
    assert names() == ["z"]
    with pytest.raises(ValueError):
        catalogue.write_catalogue(second, out, if_exists="ask")


def test_document_store(spark, tmp_path):
    chunk = spark.createDataFrame(
        [(1, "t", {"source": "s"}, [0.5])],
        "chunk_id bigint, text string, metadata map<string,string>, embedding array<float>",
    )
    catalogue.write_document_store(chunk, str(tmp_path), "articles")
    assert spark.read.parquet(str(tmp_path / "articles")).first().metadata == {"source": "s"}


def test_log(spark, tmp_path):
    lines = spark.createDataFrame([("t info: a\nb",), ("t info: c",)], "line string")
    catalogue.write_log(lines, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["t info: a\\nb", "t info: c"]


def test_listing_and_repository(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "app.txt").write_text("a.ts\n\nsrc/b.ts\n")
    rows = sorted(map(tuple, files.read_listing(spark, str(tmp_path / "lists")).collect()))
    assert rows == [("app", "a.ts"), ("app", "src/b.ts")]
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "src" / "ü.ts").write_text("let ü = 1;")
    row = files.read_repository(spark, str(tmp_path / "repo"), repo="/r/app").first()
    assert tuple(row) == ("/r/app", "src/ü.ts", "let ü = 1;", True)
    (tmp_path / "repo" / "logo.png").write_bytes(b"\x89PNG\xff\xfe")
    image = files.read_repository(spark, str(tmp_path / "repo")).where("path = 'logo.png'").first()
    assert (image.content, image.read_ok) == ("", False)


def test_scratch_folder_is_the_configured_one(spark):
    configured = spark.conf.get(session.CHECKPOINT_KEY, None)
    root = session.scratch_root(spark)
    assert root and (configured is None or root == configured.rstrip("/"))
    kept, rows = session.materialise_counted(spark.range(5).withColumn("x", F.lit(1)), "t")
    assert rows == 5 and kept.count() == 5
    assert all(root.removeprefix("file:") in f for f in kept.inputFiles())
