"""Two-step publishing, postings and the resumable job."""

import pytest
from pyspark.sql import functions as F

from corpusatlas.operators import enrich, postings, records
from corpusatlas.operators.imports import AliasRule
from corpusatlas.plans import jobs
from corpusatlas.sources import catalogue
from corpusatlas.sources.published import Published
from corpusatlas.streaming import resumable

SCHEMA = "repository string, fileName string"


def table(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def names(df):
    return sorted(r.fileName for r in df.collect())


def test_versions_and_attempts(spark, tmp_path, monkeypatch):
    store = Published(spark, str(tmp_path))
    assert store.latest() is None and store.read("t", SCHEMA).count() == 0
    assert store.publish({"t": table(spark, ("a", "x"))}, 0)
    assert not store.publish({"t": table(spark, ("a", "other"))}, 0)
    # An attempt that dies between its data and its manifest row does not count.
    with monkeypatch.context() as broken:
        broken.setattr(Published, "_name", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.publish({"t": table(spark, ("a", "lost"))}, 1)
    assert names(store.read("t", SCHEMA)) == ["x"] and not store.has(1)
    assert store.publish({"t": table(spark, ("a", "y"))}, 1)
    assert names(store.read("t", SCHEMA)) == ["x", "y"] and names(store.current("t")) == ["y"]


def test_two_attempts_that_raced_count_once(spark, tmp_path):
    store = Published(spark, str(tmp_path))
    for attempt in ("b", "a"):
        table(spark, ("r", attempt)).write.parquet(f"{tmp_path}/t/version=4/attempt={attempt}")
        store._name(4, attempt, {"t": table(spark, ("r", "x")).schema.json()})
    assert names(store.read("t", SCHEMA)) == ["a"] == names(store.current("t"))


RECORDS = [
    ("/r", "/r/a.ts", "import x from 'lodash';\nexport function one(): void {\n}\nexport class K {\n}\n"),
    ("/r", "/r/b.ts", "import x from 'lodash';\nimport y from 'lodash';\nexport interface I {\n  id: number;\n}\n"),
    ("/r", "/r/c.html", "<p><b>x</b></p>"),
    ("/s", "/s/a.ts", "import x from 'lodash';\nexport function one(): void {\n}\n"),
    ("/s", "/s/d.json", "{}"),
]


@pytest.fixture(scope="module")
def known(spark):
    rows = [(repo, path[len(repo) + 1 :], text) for repo, path, text in RECORDS]
    return jobs.index(spark.createDataFrame(rows, "repo string, path string, content string"))


EXAMPLES = [
    ({"imports": ["lodash"]}, ["/r/a.ts", "/r/b.ts", "/s/a.ts"]),
    ({"imports": ["lodash"], "repository": "/s"}, ["/s/a.ts"]),
    ({"imports": ["lodash", "none"], "functions": ["one", "two"]}, ["/r/a.ts", "/s/a.ts"]),
    ({"functions": ["one"], "classes": ["K"]}, ["/r/a.ts"]),
    ({"interfaces": ["I"]}, ["/r/b.ts"]),
    ({"tags": ["b", "i"]}, ["/r/c.html"]),
    ({"files": ["/r/a.ts", "/s/d.json"], "file_name": "/s/d.json"}, ["/s/d.json"]),
    ({"files": ["/r/a.ts"], "file_name": "/s/d.json"}, []),
    ({"repository": "/s"}, ["/s/a.ts", "/s/d.json"]),
    ({}, [path for _, path, _ in RECORDS]),
    ({"imports": ["none"]}, []),
]


@pytest.mark.parametrize(("example", "expected"), EXAMPLES)
def test_postings_equal_the_scan(spark, known, example, expected):
    found = postings.matching(postings.of_records(known.records()), postings.Example(**example))
    assert names(found) == expected == names(records.lookup(known.records(), **example))


def test_postings_of_texts_and_edges(known):
    kinds = [k for k in postings.KINDS if k != "import"] + [postings.FILE]
    rows = postings.of_files(known.files, kinds).unionByName(postings.of_edges(known.edges).distinct())
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, postings.of_records(known.records()).collect()))
    assert postings.of_files(known.files, []).count() == 0


def test_published_catalogue(spark, known, tmp_path):
    root = str(tmp_path / "c")
    assert catalogue.publish_catalogue(known.records(), root) == 0
    back = catalogue.read_published_catalogue(spark, root)
    plain = lambda df: sorted(df.select("repository", "fileName", F.to_json("json"), F.to_json("functions")).collect(), key=str)
    assert plain(back) == plain(known.records())
    example = postings.Example(imports=["lodash"], classes=["K"])
    found = catalogue.lookup_published(spark, root, example)
    assert names(found) == ["/r/a.ts"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "kind#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan and "lodash" in plan.split("PushedFilters: [")[1]
    half = known.records().where("repository = '/s'")
    with pytest.raises(FileExistsError):
        catalogue.publish_catalogue(half, root)
    assert catalogue.publish_catalogue(half, root, "skip") == 0
    assert catalogue.publish_catalogue(half, root, "rebuild") == 1
    assert names(catalogue.read_published_catalogue(spark, root)) == ["/s/a.ts", "/s/d.json"]


def test_failed_rebuild_leaves_the_version_before(spark, known, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    catalogue.publish_catalogue(known.records(), root)
    with monkeypatch.context() as broken:
        broken.setattr(Published, "_name", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            catalogue.publish_catalogue(known.records().limit(1), root, "rebuild")
    assert catalogue.read_published_catalogue(spark, root).count() == len(RECORDS)


# ---- the resumable job ----


@pytest.fixture(scope="module")
def many(spark):
    rows = [("/r", f"src/f{i:02}.ts", f"import a from './f{(i + 1) % 25:02}';\nSentence {i}. More.") for i in range(25)]
    rows += [("/s", f"g{i}.json", "{}") for i in range(3)]
    return jobs.index(spark.createDataFrame(rows, "repo string, path string, content string"), [AliasRule("@x/*", ("src/*",))])


def queued(spark, many, tmp_path, **options):
    job = resumable.ResumableJob(spark, many, str(tmp_path / "queue"), str(tmp_path / "root"), **options)
    n = resumable.queue(resumable.pending_files(many, job.summaries()), job.queue_folder, files_per_batch=5)
    return job, n


def test_a_bounded_queue_keeps_batches_whole(spark, many, tmp_path):
    job = resumable.ResumableJob(spark, many, str(tmp_path / "queue"), str(tmp_path / "root"))
    pending = resumable.pending_files(many, job.summaries())
    n = resumable.queue(pending, job.queue_folder, files_per_batch=2, most_files=4)
    stored = list((tmp_path / "queue").glob("batch=*/*.parquet"))
    assert n == len(stored) <= 4
    rows = spark.read.parquet(job.queue_folder).select("repo", "path", "batch_no", "batch").collect()
    assert len(rows) == len({(r.repo, r.path) for r in rows}) == pending.count()
    held = {(r.repo, r.batch_no) for r in rows}
    assert len(held) > 4 and len({(r.repo, r.batch_no, r.batch) for r in rows}) == len(held)
    job.run(batches_per_commit=-(-n // 2))
    assert job.store.manifest().count() == 2 and job.summaries().count() + job.quarantine().count() == len(rows)


def test_killed_in_its_second_batch(spark, many, tmp_path, monkeypatch):
    """Killed after the data of batch 2 and before its manifest row; then run again."""
    job, n = queued(spark, many, tmp_path)
    assert n == 6
    real, seen = Published._name, []

    def dies(self, version, attempt, schemas):
        seen.append(version)
        if len(seen) == 2:
            raise RuntimeError("killed")
        real(self, version, attempt, schemas)

    with monkeypatch.context() as broken:
        broken.setattr(Published, "_name", dies)
        with pytest.raises(Exception, match="killed"):
            job.run(2)
    assert [r.version for r in job.store.manifest().collect()] == [0]
    before = {(r.path, r.batch_no) for r in job.summaries().collect()}
    assert 0 < len(before) <= 10
    job.run(2)
    rows = job.summaries().collect()
    assert len(rows) == len({r.abs_path for r in rows}) == 28
    assert before <= {(r.path, r.batch_no) for r in rows}
    assert sorted(r.version for r in job.store.manifest().collect()) == [0, 1, 2]
    assert {(r.repo, r.batch_no): 0 for r in rows}.keys() == {("/r", b) for b in range(5)} | {("/s", 0)}
    # Nothing is left; a file that is queued again is not enriched again.
    job.run(2)
    again = many.manifest.select("repo", "path", "abs_path").limit(4)
    resumable.queue(again, job.queue_folder, files_per_batch=5)
    job.run(2)
    assert job.summaries().count() == 28


def test_published_but_not_noted_by_the_stream(spark, many, tmp_path):
    """The stream forgets its last commit: the batch comes again and is published once."""
    job, _ = queued(spark, many, tmp_path)
    job.run(3)
    last = max(int(p.name) for p in (tmp_path / "root" / "progress" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "root" / "progress" / "commits" / name).unlink(missing_ok=True)
    rows = job.summaries().count()
    job.run(3)
    assert job.summaries().count() == rows == 28


def test_model_reads_the_guarded_prompt_and_failures_wait(spark, many, tmp_path):
    def model(rows, step, n):
        assert all("Related files:" in p for p in rows.prompt)
        if step == "summary":
            bad = lambda path: path == "src/f03.ts"
            return ["broken" if bad(p) else '{"fileDescription": "d", "tag": "ui"}' for p in rows.path]
        return ["x"] * len(rows)

    job, _ = queued(spark, many, tmp_path, model=model, passes=1)
    job.run(6)
    assert [r.path for r in job.quarantine().collect()] == ["src/f03.ts"]
    assert job.summaries().count() == 27
    left = resumable.pending_files(many, job.summaries())
    assert [r.path for r in left.collect()] == ["src/f03.ts"]
    # Queued again, with the default steps, it goes through.
    later = resumable.ResumableJob(spark, many, job.queue_folder, job.root)
    resumable.queue(left, job.queue_folder, enrich.BATCH_FILES)
    later.run()
    assert later.summaries().count() == 28
