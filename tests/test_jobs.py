import json

import pytest

from corpusatlas.operators.imports import AliasRule
from corpusatlas.operators import documents
from corpusatlas.plans import jobs

FILES = [
    ("/r", "src/a.ts", "import b from '@x/b';\nimport s from './skip-me';\nA. Second."),
    ("/r", "src/b.ts", "B one. B two."),
    ("/r", "src/skip-me.ts", "S."),
    ("/r", "c.json", "{}"),
    ("/r", "d.scss", "p"),
]


@pytest.fixture(scope="module")
def catalogue(spark):
    listing = spark.createDataFrame(FILES, "repo string, path string, content string")
    return jobs.index(listing, [AliasRule("@x/*", ("src/*",))], excluded=["skip"])


def test_excluded_files_still_resolve(catalogue):
    got = {r.target for r in catalogue.edges.collect()}
    assert got == {"/r/src/b.ts", "/r/src/skip-me.ts"}
    assert {r.fileName for r in catalogue.records().collect()} == {"/r/src/a.ts", "/r/src/b.ts", "/r/c.json"}


def test_enrich_commit_and_resume(spark, catalogue, tmp_path):
    folder = str(tmp_path)
    none = catalogue.manifest.limit(0)

    def model(rows, step, n):
        assert all("Related files:" in p for p in rows.prompt)
        out = []
        for path in rows.path:
            if step == "summary" and path == "c.json":
                out.append("no answer")
            else:
                out.append(json.dumps({"fileDescription": path, "tag": "ui"}))
        return out

    jobs.commit(jobs.enrich_pending(catalogue, none, model=model), folder, 0)
    done = jobs.committed(spark, folder)
    assert {r.path for r in done.collect()} == {"src/a.ts", "src/b.ts"}
    assert [r.path for r in spark.read.parquet(f"{folder}/quarantine").collect()] == ["c.json"]
    # The failed file is still pending, and only that one.
    again = jobs.enrich_pending(catalogue, done)
    assert [(r.path, r.outcome) for r in again.collect()] == [("c.json", "valid")]
    jobs.commit(again, folder, 1)
    jobs.commit(again, folder, 1)
    done = jobs.committed(spark, folder)
    assert done.count() == 3
    assert jobs.enrich_pending(catalogue, done).count() == 0


def test_context_of_pending_files(catalogue):
    rows = {r.path: r.prompt for r in jobs.enrich_pending(catalogue, catalogue.manifest.limit(0)).collect()}
    # An excluded file has no prompt of its own but still serves as context.
    assert "Related files:\nB one. B two.\nS.\n\n" in rows["src/a.ts"]
    assert "src/skip-me.ts" not in rows


def test_chunks_with_vectors(spark, catalogue):
    chunks = documents.from_files(catalogue.files, size=2)
    bare = documents.with_vectors(chunks, spark.createDataFrame([], "chunk_id string, embedding array<float>"))
    ids = [r.chunk_id for r in bare.collect()]
    assert len(set(ids)) == len(ids) == chunks.count()
    vectors = spark.createDataFrame([(ids[0], [1.0])], "chunk_id string, embedding array<float>")
    found = documents.with_vectors(chunks, vectors).where("embedding is not null").collect()
    assert [r.chunk_id for r in found] == [ids[0]]
