"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from corpusatlas.operators import imports, manifest, telemetry
from corpusatlas.plans.queries import QUERIES
from corpusatlas.sources.code_files import ALIASES, code_files, located

PYTHON_ALLOWED = {"vector_topk", "vector_topk_centres", "vector_topk_lsh", "vector_topk_cells"}
NARROW = [
    "manifest_scan", "exclude_projects", "path_extension", "import_specifiers", "extract_classes",
    "chunk_documents", "token_counts", "validate_summary", "enrichment_outcome", "refine_passes",
    "docs_from_files", "html_tag_attrs", "tolerant_json", "log_line_format", "tier_lookup",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in PYTHON_ALLOWED])
def test_no_cross_joins_and_no_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


@pytest.mark.parametrize("name", NARROW)
def test_no_shuffle(spark, sf, name):
    assert "Exchange" not in plan(QUERIES[name](spark, sf))


def test_manifest_reads_no_content(spark, sf, tmp_path):
    stored = str(tmp_path / "files")
    located(code_files(spark, sf)).write.partitionBy("repo").parquet(stored)
    files = spark.read.parquet(stored)
    text = plan(manifest.eligible(manifest.scan(files.select("repo", "path"))))
    assert re.search(r"ReadSchema: struct<path:string>", text)
    wanted = plan(imports.references(files.where("repo = '/r/app1'")))
    assert "EqualTo(ext,.ts)" in wanted and "PartitionFilters: [isnotnull(repo" in wanted


def test_top_k_ranks_before_the_shuffle(spark, sf):
    text = plan(QUERIES["vector_topk"](spark, sf))
    assert "WindowGroupLimit" in text


def test_totals_combine_before_the_shuffle(spark, sf):
    events = spark.createDataFrame(
        [], "run bigint, event_id bigint, ts timestamp_ntz, kind string, completion_tokens bigint, "
        "prompt_tokens bigint, total_tokens bigint"
    )
    assert "partial_sum" in plan(telemetry.usage_totals(events))


def test_resolution_has_no_nested_loop(spark, sf):
    files = located(code_files(spark, sf))
    edges = imports.resolve(
        imports.references(files), manifest.scan(files.select("repo", "path")), ALIASES, rows_per_split=10
    )
    text = plan(edges)
    assert "BroadcastNestedLoopJoin" not in text and "_split" in text
    assert edges.agg(F.count("*")).first()[0] > 0
