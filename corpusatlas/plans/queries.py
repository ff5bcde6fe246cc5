"""Registered queries: each reads the tables below a folder and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusatlas.functions import answers, markup, paths, source, text
from corpusatlas.operators import (
    cells,
    context,
    conversations,
    documents,
    enrich,
    graph,
    imports,
    manifest,
    merging,
    postings,
    records,
    rollups,
    telemetry,
    vectors,
)
from corpusatlas.plans import jobs
from corpusatlas.session import materialise, scratch_folder
from corpusatlas.sources import catalogue
from corpusatlas.sources.code_files import ALIASES, code_files, located
from corpusatlas.sources.files import tolerant_text
from corpusatlas.streaming import resumable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# ---- inputs ------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return code_files(spark, sf).select("repo", "path")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.scan(_listing(spark, sf))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return located(code_files(spark, sf))


class _Corpus:
    """The code files, their texts and their manifest; no text is stored."""

    def __init__(self, spark: SparkSession, sf: str):
        self.files = located(code_files(spark, sf))
        self.contents = self.files.select("abs_path", "content")
        self.manifest = manifest.scan(code_files(spark, sf).select("repo", "path"))

    def references(self, assets: bool = True) -> DataFrame:
        return imports.references(self.files, assets=assets)

    def edges(self, assets: bool = True) -> DataFrame:
        return imports.resolve(self.references(assets), self.manifest, ALIASES)

    def edge_table(self) -> DataFrame:
        return materialise(self.edges(), "edges")

    def records(self) -> DataFrame:
        return records.file_records(self.files, self.edges())


def _document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files whose extension follows the language."""
    lang = F.col("lang")
    suffix = (
        F.when(lang == "en", ".ts")
        .when(lang == "fr", ".html")
        .when(lang == "de", ".json")
        .otherwise("/index.ts")
    )
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return _table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("content")
    )


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Structured answers made from documents in eight forms, right and wrong."""
    said = F.regexp_replace("text", "[^a-zA-Z0-9]+", " ")

    def body(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    plain = body('{"fileDescription": "', said, '", "tag": "feature"')
    form = F.col("doc_id") % 8
    answer = (
        F.when(form == 0, body(plain, "}"))
        .when(form == 1, F.lit('{"tag": "ui"}'))
        .when(form == 2, body('{"fileDescription": "', said, '", "tag": "other"}'))
        .when(form == 3, plain)
        .when(form == 4, body("```json\n", plain, "}\n```"))
        .when(form == 5, body(plain, ', "businessLogic": {"rules": "r"}}'))
        .when(
            form == 6,
            body(plain, ', "flowDescription": {"initialization": "i", "processingSteps": ["a"]}}'),
        )
        .otherwise(body('{"fileDescription": ', F.col("n_chars").cast("string"), ', "tag": "ui"}'))
    )
    return _table(spark, sf, "documents").select("doc_id", answer.alias("answer"))


def _usage_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as telemetry: a user is a run, and `k` of the properties counts tokens."""
    kind = F.col("event_type")
    kinds = (
        F.when(kind == "view", telemetry.CHAIN_START)
        .when(kind == "purchase", telemetry.MODEL_END)
        .when(kind == "error", telemetry.MODEL_START)
        .when(kind == "signup", telemetry.RETRIEVER_START)
        .when(kind == "click", telemetry.RETRIEVER_END)
    )
    completion = F.get_json_object("props", "$.k").cast("bigint")
    prompt = F.floor("value").cast("bigint")
    return _table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        "event_id",
        "ts",
        kinds.alias("kind"),
        completion.alias("completion_tokens"),
        prompt.alias("prompt_tokens"),
        (completion + prompt).alias("total_tokens"),
    )


def _label_centres(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean of its vectors, reduced before the shuffle."""
    values = _table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("query_id"), F.posexplode("embedding").alias("pos", "v")
    )
    means = values.groupBy("query_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One entry per dimension.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("query_id").agg(
        F.transform(ordered, lambda e: e["v"]).alias("embedding")
    )


# ---- sources, filters, projections -------------------------------------------


@query
def manifest_scan(spark, sf):
    return _manifest(spark, sf).select("repo", "path", "abs_path", "ext", "basename")


@query
def manifest_union_repos(spark, sf):
    pages = _table(spark, sf, "pages").select(
        F.lit("/r/pages").alias("repo"),
        F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
    )
    docs = _table(spark, sf, "documents").select(
        F.concat(F.lit("/r/"), "source").alias("repo"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
    )
    listings = (_listing(spark, sf), pages, docs)
    return manifest.union(*(manifest.scan(one) for one in listings)).select("repo", "abs_path")


@query
def content_or_empty(spark, sf):
    # The bytes of a .yaml file are no text here.
    stored = F.when(F.col("ext") == ".yaml", F.unhex(F.lit("FFFE"))).otherwise(
        F.encode("content", "UTF-8")
    )
    content, read_ok = tolerant_text(stored)
    read = _files(spark, sf).withColumns({"content": content, "_ok": read_ok})
    joined = manifest.with_content(_manifest(spark, sf), read.where("_ok").drop("_ok"))
    return joined.select("repo", "path", "content", "read_ok")


@query
def log_line_format(spark, sf):
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    message = F.concat("event_type", F.lit(" "), "props")
    lines = _table(spark, sf, "events").select(
        "event_id", telemetry.log_line(F.col("ts"), level, message).alias("line")
    )
    parsed = telemetry.parse_log_line(F.col("line"))
    return lines.select("event_id", "line", parsed["level"].alias("level"), parsed["message"].alias("message"))


@query
def exclude_projects(spark, sf):
    return manifest.exclude(_manifest(spark, sf), ["pkg3", "mod1"]).select("repo", "path")


@query
def exclude_many_names(spark, sf):
    small = _table(spark, sf, "part").where("p_size < 20")
    names = small.select(F.concat(F.lit("mod"), F.col("p_partkey").cast("string"), F.lit(".")).alias("name"))
    return manifest.exclude_names(_manifest(spark, sf), names).select("repo", "path")


@query
def path_extension(spark, sf):
    return _listing(spark, sf).select("repo", "path", paths.extension(F.col("path")).alias("ext"))


@query
def eligible_files(spark, sf):
    return manifest.eligible(_manifest(spark, sf)).select("repo", "path", "ext")


@query
def pending_files(spark, sf):
    done = _table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    summaries = manifest.scan(code_files(spark, sf).join(done, "k", "left_semi"))
    return manifest.pending(_manifest(spark, sf), summaries).select("repo", "path")


@query
def normalize_path(spark, sf):
    raw = F.concat("repo", F.lit("/x/.././"), "path")
    return _listing(spark, sf).select(
        "repo", "path", paths.normalize(raw).alias("normalized"),
        paths.resolve(F.col("repo"), F.concat(F.lit("../../../"), "path")).alias("above_root"),
    )


@query
def path_parts(spark, sf):
    padded = F.concat(F.lit("  "), "repo", F.lit(" "))
    return _listing(spark, sf).select(
        F.trim(padded).alias("repo"),
        "path",
        paths.base_name(F.col("repo")).alias("repo_name"),
        paths.base_name(F.col("path")).alias("file_name"),
        paths.dir_name(F.col("path")).alias("folder"),
    )


@query
def context_kind(spark, sf):
    return _manifest(spark, sf).select(
        "repo", "path", manifest.context_kind(F.col("ext")).alias("kind")
    )


@query
def repos_with_marker(spark, sf):
    listed = _manifest(spark, sf)
    return manifest.repositories_with(listed.select("repo").distinct(), listed, "src/pkg0/mod7.json")


# ---- extraction --------------------------------------------------------------


@query
def import_specifiers(spark, sf):
    refs = imports.references(_files(spark, sf), assets=False)
    return refs.select("repo", "path", "pos", "specifier")


def _resolution(edges: DataFrame) -> DataFrame:
    return edges.select("repo", "path", "pos", "specifier", "target", "resolved")


@query
def resolve_relative_imports(spark, sf):
    corpus = _Corpus(spark, sf)
    relative = corpus.references(assets=False).where(F.col("kind") == imports.RELATIVE)
    return _resolution(imports.resolve(relative, corpus.manifest))


@query
def resolve_alias_imports(spark, sf):
    corpus = _Corpus(spark, sf)
    bare = corpus.references(assets=False).where(F.col("kind") == imports.BARE)
    # A table of rules per repository, as read from each one's settings.
    repos = corpus.manifest.select("repo").distinct()
    table = repos.withColumn("aliases", imports.alias_column(ALIASES))
    return _resolution(imports.resolve(bare, corpus.manifest, table, use_base=False))


@query
def resolve_imports_all(spark, sf):
    edges = _Corpus(spark, sf).edges(assets=False)
    return edges.select("repo", "path", "pos", "specifier", "target", "resolved", "is_external")


@query
def augment_imports(spark, sf):
    edges = _Corpus(spark, sf).edges()
    return edges.select("repo", "path", "pos", "kind", "target", "resolved")


@query
def decorator_assets(spark, sf):
    files = _files(spark, sf).where(F.col("ext") == ".ts")
    found = source.decorator_assets(F.col("content"))
    return files.select("repo", "path", F.posexplode(found).alias("asset_no", "asset"))


@query
def extract_functions(spark, sf):
    files = _files(spark, sf).where(F.col("ext") == ".ts")
    found = files.select(
        "repo", "path", F.explode(source.functions(F.col("content"))).alias("f")
    )
    return found.select(
        "repo", "path", F.col("f.name").alias("name"), F.col("f.returnType").alias("return_type"),
        F.posexplode_outer("f.parameters").alias("param_no", "p"),
    ).select(
        "repo", "path", "name", "return_type", "param_no",
        F.col("p.name").alias("param_name"), F.col("p.type").alias("param_type"),
    )


@query
def extract_classes(spark, sf):
    files = _files(spark, sf).where(F.col("ext") == ".ts")
    found = files.select("repo", "path", F.explode(source.classes(F.col("content"))).alias("c"))
    methods = found.select(
        "repo", "path", F.col("c.name").alias("class_name"), F.explode_outer("c.methods").alias("m")
    )
    return methods.select(
        "repo", "path", "class_name", F.col("m.name").alias("method"),
        F.col("m.returnType").alias("return_type"), F.explode_outer("m.parameters").alias("p"),
    ).select(
        "repo", "path", "class_name", "method", "return_type",
        F.col("p.name").alias("param_name"), F.col("p.type").alias("param_type"),
    )


@query
def extract_decorators(spark, sf):
    files = _files(spark, sf).where(F.col("ext") == ".ts")
    found = files.select("repo", "path", F.explode(source.classes(F.col("content"))).alias("c"))
    used = found.select(
        "repo", "path", F.col("c.name").alias("class_name"), F.explode("c.decorators").alias("d")
    )
    return used.select(
        "repo", "path", "class_name", F.col("d.name").alias("decorator"),
        F.posexplode_outer("d.arguments").alias("arg_no", "argument"),
    )


@query
def extract_interfaces(spark, sf):
    files = _files(spark, sf).where(F.col("ext") == ".ts")
    found = files.select("repo", "path", F.explode(source.interfaces(F.col("content"))).alias("i"))
    return found.select(
        "repo", "path", F.col("i.name").alias("name"),
        F.posexplode_outer("i.properties").alias("prop_no", "p"),
    ).select(
        "repo", "path", "name", "prop_no",
        F.col("p.name").alias("prop_name"), F.col("p.type").alias("prop_type"),
    )


def _declared_files(spark: SparkSession, sf: str) -> DataFrame:
    """One text with a decorated class and an interface for every document; brackets nest up to 40 levels."""
    deep = (F.col("doc_id") % 40 + 1).cast("int")

    def nested(left: str, middle: str, right: str) -> Column:
        return F.concat(F.repeat(F.lit(left), deep), F.lit(middle), F.repeat(F.lit(right), deep))

    number = F.col("doc_id").cast("string")
    parts = [
        "@Injectable()\nexport class D", number, " extends Base<Map<string, Array<x>>> {\n  private count = 0;\n\n"
        "  constructor(private readonly source: Source) {\n  }\n\n  get size(): number {\n    return this.count;\n  }\n\n"
        "  set size(v: number) {\n    this.count = v;\n  }\n\n  @Input()\n  @HostListener('", F.col("source"), "', ['$event'])\n"
        "  async on", number, "(event: Event, deep: string = ", nested("(", "1", ")"), "): Promise<Map<string, number>> {\n"
        "    if (a) { return ", nested("[", "2", "]"), "; }\n  }\n\n  empty() {}\n}\nexport class Empty {}\n"
        "export interface I", number, " {\n  id: ", nested("{ a: ", "string", " }"), ";\n  call: ", nested("(x: ", "y", ") => void"), ";\n}\n",
    ]
    content = F.concat(*(F.lit(part) if isinstance(part, str) else part for part in parts))
    return _table(spark, sf, "documents").select("doc_id", content.alias("content"))


@query
def extract_method_decorators(spark, sf):
    found = _declared_files(spark, sf).select("doc_id", F.explode(source.classes(F.col("content"))).alias("c"))
    methods = found.select(
        "doc_id", F.col("c.name").alias("class_name"), F.size("c.decorators").alias("n_class_decorators"), F.explode_outer("c.methods").alias("m")
    )
    used = methods.select(
        "doc_id", "class_name", "n_class_decorators", F.col("m.name").alias("method"), F.col("m.returnType").alias("return_type"),
        F.to_json("m.parameters").alias("parameters"), F.posexplode_outer("m.decorators").alias("decorator_no", "d"),
    )
    return used.select(
        "doc_id", "class_name", "n_class_decorators", "method", "return_type", "parameters", "decorator_no",
        F.col("d.name").alias("decorator"), F.posexplode_outer("d.arguments").alias("argument_no", "argument"),
    )


@query
def extract_deep_types(spark, sf):
    found = _declared_files(spark, sf).select("doc_id", F.explode(source.interfaces(F.col("content"))).alias("i"))
    return found.select("doc_id", F.col("i.name").alias("name"), F.posexplode("i.properties").alias("prop_no", "p")).select(
        "doc_id", "name", "prop_no", F.col("p.name").alias("prop_name"), F.col("p.type").alias("prop_type")
    )


@query
def html_tag_counts(spark, sf):
    counts = F.inline(markup.tag_counts(F.col("html")))
    return _table(spark, sf, "pages").select("page_id", counts)


@query
def html_tag_attrs(spark, sf):
    rows = _table(spark, sf, "pages").select(
        "page_id", F.posexplode(markup.tags(F.col("html"))).alias("tag_no", "t")
    )
    return rows.select(
        "page_id", "tag_no", F.col("t.tag").alias("tag"), F.explode("t.attrs").alias("attr", "value")
    )


@query
def tolerant_json(spark, sf):
    files = _files(spark, sf).where(F.col("ext") == ".json")
    parsed = answers.tolerant(F.col("content"))
    return files.select(
        "repo", "path", answers.parses(F.col("content")).alias("parse_ok"),
        F.try_variant_get(parsed, "$.k", "bigint").alias("k"),
    )


@query
def tolerant_json_props(spark, sf):
    parsed = answers.tolerant(F.col("props"))
    return _table(spark, sf, "events").select(
        "event_id", answers.parses(F.col("props")).alias("parse_ok"),
        F.try_variant_get(parsed, "$.k", "bigint").alias("k"),
    )


def _record_rows(rows: DataFrame) -> DataFrame:
    def names(column: str, field: str) -> Column:
        return F.array_join(F.transform(F.col(column), lambda x: x[field]), ",").alias(column)

    return rows.select(
        "repository", "fileName", F.array_join("imports", ",").alias("imports"),
        names("functions", "name"), names("classes", "name"), names("interfaces", "name"),
        F.size("tags").cast("bigint").alias("n_tags"),
        F.to_json("json").alias("json"), "sourceCode",
    )


@query
def file_record(spark, sf):
    return _record_rows(_Corpus(spark, sf).records())


# ---- graph and context -------------------------------------------------------


@query
def internal_edges(spark, sf):
    return graph.internal(_Corpus(spark, sf).edges()).select("repo", "path", "pos", "target")


def _dependency_context(spark: SparkSession, sf: str, **limits) -> DataFrame:
    corpus = _Corpus(spark, sf)
    sizes = context.sizes(corpus.contents)
    gathered = context.code_context(corpus.edges(), corpus.contents, sizes, **limits)
    return gathered.select(F.col("owner").alias("abs_path"), "related", "n_tokens")


@query
def dependency_context(spark, sf):
    return _dependency_context(spark, sf)


@query
def dependency_context_cut(spark, sf):
    return _dependency_context(spark, sf, limit=40, cut=400)


@query
def dependency_pieces(spark, sf):
    """The contexts of `dependency_context` as numbered rows of at most 64 characters."""
    corpus = _Corpus(spark, sf)
    made = context.in_pieces(
        graph.code_pieces(corpus.edges()), corpus.contents, context.sizes(corpus.contents), split_owners=False, piece_chars=64
    )
    return made.select(F.col("owner").alias("abs_path"), "piece_no", "text")


@query
def template_importers(spark, sf):
    corpus = _Corpus(spark, sf)
    found = graph.template_importers(corpus.edge_table(), corpus.manifest)
    return found.select("template", "importer")


@query
def template_context(spark, sf):
    corpus = _Corpus(spark, sf)
    sizes = context.sizes(corpus.contents)
    gathered = context.template_context(
        corpus.edge_table(), corpus.manifest, corpus.contents, sizes
    )
    return gathered.select(F.col("owner").alias("template"), "related", "n_tokens")


@query
def prompt_assembly(spark, sf):
    corpus = _Corpus(spark, sf)
    made = context.prompts(corpus.files, corpus.edge_table(), corpus.manifest)
    return made.select("repo", "path", "context_kind", "n_tokens", "prompt")


@query
def filter_graph_nodes(spark, sf):
    nodes = graph.project_nodes(_manifest(spark, sf), depth=2)
    return graph.filter_nodes(nodes, ["pkg3"])


@query
def filter_graph_edges(spark, sf):
    edges = graph.project_edges(_Corpus(spark, sf).edges(), depth=2)
    return graph.filter_edges(edges, ["pkg3"])


# ---- enrichment --------------------------------------------------------------


@query
def batch_assignment(spark, sf):
    listed = _manifest(spark, sf)
    batched = enrich.assign_batches(
        manifest.eligible(listed).select("repo", "path"), at_most=listed.count()
    )
    return batched.select("repo", "path", "batch_no")


@query
def summary_upsert(spark, sf):
    existing = _table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "feature").otherwise("utility").alias("tag"),
        F.lit(0).alias("batch_id"),
    )
    new = _table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("ui-"), "source").alias("tag"), F.lit(1).alias("batch_id")
    )
    return enrich.upsert(existing, new, ["doc_id"])


@query
def summary_merge(spark, sf):
    """The same table by merges into stored buckets: labels first, then documents in two batches."""
    schema = StructType.fromDDL("doc_id bigint, tag string, batch_id int")
    table = merging.MergedTable.create(spark, f"{scratch_folder(spark)}/merged-{uuid.uuid4().hex}", schema, ["doc_id"])
    labels, docs = _table(spark, sf, "labels"), _table(spark, sf, "documents")
    tag = F.when(F.col("quality") == 1, "feature").otherwise("utility")
    table.merge(labels.select("doc_id", tag.alias("tag"), F.lit(0).alias("batch_id")))
    new = docs.select("doc_id", F.concat(F.lit("ui-"), "source").alias("tag"))
    for batch, rows in ((1, new), (2, new.where("doc_id % 100 = 0"))):
        table.merge(rows.withColumn("batch_id", F.lit(batch)))
    return table.read()


@query
def refine_passes(spark, sf):
    answer = F.col("answer")
    return enrich.refine(_document_files(spark, sf)).select(
        "doc_id",
        F.get_json_object(answer, "$.fileDescription").alias("description"),
        F.get_json_object(answer, "$.tag").alias("tag"),
        F.get_json_object(answer, "$.elementsDetail.tokens").cast("bigint").alias("tokens"),
        F.get_json_object(answer, "$.elementsDetail.sentences").cast("bigint").alias("sentences"),
        F.get_json_object(answer, "$.elementsDetail.verification").alias("verification"),
    )


@query
def verify_pass(spark, sf):
    return enrich.refine(_document_files(spark, sf), passes=1).select(
        "doc_id", "questions", "answers"
    )


@query
def validate_summary(spark, sf):
    checked = enrich.validated(_answers(spark, sf))
    return checked.select(
        "doc_id",
        (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", ",").alias("errors"),
    )


@query
def repair_summary(spark, sf):
    failed = enrich.validated(_answers(spark, sf)).where(F.size("errors") > 0)
    fixed = answers.repaired(F.col("answer"))
    return failed.select("doc_id", fixed.alias("repaired")).select(
        "doc_id",
        "repaired",
        (F.size(answers.errors(F.col("repaired"))) == 0).alias("valid"),
    )


@query
def enrichment_outcome(spark, sf):
    return enrich.outcome(_answers(spark, sf)).select("doc_id", "outcome", "summary", "reason")


@query
def enrich_pending(spark, sf):
    corpus = _Corpus(spark, sf)
    done = _table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    summaries = manifest.scan(code_files(spark, sf).join(done, "k", "left_semi"))
    catalogue = jobs.index(corpus.files.select("repo", "path", "content"), ALIASES)
    made = jobs.enrich_pending(catalogue, summaries)
    return made.select(
        "repo", "path", "n_tokens", F.get_json_object("summary", "$.tag").alias("tag"),
        F.get_json_object("summary", "$.elementsDetail.digest").alias("digest"), "outcome",
    )


#: Queue files of the registered job, however many batches there are.
QUEUE_FILES = 1_024


@query
def enrich_resumable(spark, sf):
    """The whole job as a stream of two commits, from a queue of numbered batches."""
    corpus = _Corpus(spark, sf)
    known = jobs.index(corpus.files.select("repo", "path", "content"), ALIASES)
    root = f"{scratch_folder(spark)}/resumable-{uuid.uuid4().hex}"
    job = resumable.ResumableJob(spark, known, f"{root}/queue", root)
    n_files = resumable.queue(resumable.pending_files(known, job.summaries()), job.queue_folder, most_files=QUEUE_FILES)
    job.run(batches_per_commit=-(-n_files // 2))
    done, n_commits = job.summaries(), job.store.manifest().count()
    return done.select(
        "repo", "path", "batch_no", "n_tokens", F.get_json_object("summary", "$.tag").alias("tag"),
        F.get_json_object("summary", "$.elementsDetail.digest").alias("digest"), "outcome",
        F.lit(n_commits).cast("bigint").alias("n_commits"),
    )


@query
def repo_summary(spark, sf):
    corpus = _Corpus(spark, sf)
    return records.repo_summary(corpus.manifest, corpus.edge_table())


@query
def repo_rollup_merged(spark, sf):
    """Roll-up rows of two batches of files, published and merged; the estimate against the true number."""
    corpus = _Corpus(spark, sf)
    edges, listed = corpus.edge_table(), corpus.manifest
    first = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    root = f"{scratch_folder(spark)}/rollup-{uuid.uuid4().hex}"
    for batch, wanted in enumerate((first, ~first)):
        rollups.store(rollups.partial(listed.where(wanted), edges.where(wanted)), root, batch)
    exact = graph.internal(edges).where("resolved").groupBy("repo").agg(F.count_distinct("target").alias("_exact"))
    found = rollups.totals(spark, root).join(exact, "repo", "left")
    off = F.abs(F.col("n_targets") - F.coalesce("_exact", F.lit(0)))
    return found.select("repo", *rollups.COUNTS, (off <= rollups.ERROR * F.col("_exact")).alias("targets_within_error"))


@query
def repo_tag_rollup(spark, sf):
    return records.tag_rollup(_manifest(spark, sf))


@query
def catalogue_lookup(spark, sf):
    example = postings.Example(repository="/r/app0", imports=["lodash"])
    # Only the repository's own texts are read, and only imports are taken from them.
    own = _files(spark, sf).where(F.col("repo") == example.repository)
    edges = imports.resolve(imports.references(own), _manifest(spark, sf), ALIASES)
    return postings.matching(postings.of_edges(edges), example)


def _published_catalogue(spark: SparkSession, sf: str) -> str:
    root = f"{scratch_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    catalogue.publish_catalogue(_Corpus(spark, sf).records(), root)
    return root


@query
def catalogue_postings(spark, sf):
    """Files with a function or class of some names and a resolved import, from the stored postings."""
    example = postings.Example(
        imports=["lodash"], functions=[f"fn{k}" for k in range(0, 400, 4)], classes=[f"C{k}" for k in range(0, 400, 10)]
    )
    return catalogue.lookup_published(spark, _published_catalogue(spark, sf), example)


@query
def catalogue_roundtrip(spark, sf):
    return _record_rows(catalogue.read_published_catalogue(spark, _published_catalogue(spark, sf)))


@query
def document_store_roundtrip(spark, sf):
    files = code_files(spark, sf)
    chunks = documents.from_files(located(files))
    key = documents.chunk_key(paths.base_name(F.col("repo")), F.col("path"), F.lit(0))
    stored = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    embeddings = files.join(stored, "k").select(F.sha2(key, 256).alias("chunk_id"), "embedding")
    root = f"{scratch_folder(spark)}/documents-{uuid.uuid4().hex}"
    catalogue.publish_document_store(documents.with_vectors(chunks, embeddings), root)
    back = catalogue.read_published_documents(spark, root)
    return back.select(
        "chunk_id", "text", F.col("metadata")["source"].alias("source"), F.size("embedding").cast("bigint").alias("n_dims")
    )


# ---- documents ---------------------------------------------------------------


def _flat(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*(F.col("metadata")[k].alias(k) for k in keys), "chunk_no", "text")


@query
def docs_from_files(spark, sf):
    docs = documents.from_files(_files(spark, sf))
    return _flat(docs, "repository", "repositoryUrl", "source")


@query
def docs_from_records(spark, sf):
    rows = _Corpus(spark, sf).records()
    return _flat(documents.from_records(rows), "repository", "source")


@query
def chunk_documents(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return documents.chunked(docs, size=250)


@query
def chunk_overlap(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return documents.chunked(docs, size=250, overlap=50)


@query
def token_counts(spark, sf):
    return _table(spark, sf, "documents").select(
        "doc_id", text.token_count(F.col("text")).alias("n_tokens")
    )


@query
def size_guard(spark, sf):
    docs = _table(spark, sf, "documents").withColumn("n_tokens", text.token_count(F.col("text")))
    guarded = text.size_guard(F.col("text"), F.col("n_tokens"), limit=300, cut=1000)
    return docs.select("doc_id", "n_tokens", guarded.alias("text"))


@query
def size_tier_routing(spark, sf):
    tier = text.size_tier(text.token_count(F.col("text"))).alias("tier")
    return _table(spark, sf, "documents").groupBy(tier).agg(F.count(F.lit(1)).alias("n_docs"))


@query
def tier_lookup(spark, sf):
    lang = F.col("lang")
    mode = (
        F.when(lang == "en", "openai-std").when(lang == "de", "azure-std")
        .when(lang == "fr", "gpt4turbo").otherwise("other")
    )
    docs = _table(spark, sf, "documents").select("doc_id", mode.alias("mode"))
    return documents.with_tier(docs)


@query
def escape_braces(spark, sf):
    marked = F.concat(F.lit("{"), "lang", F.lit("} "), "text")
    return _table(spark, sf, "documents").select("doc_id", text.escape_braces(marked).alias("escaped"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of the searches: every vector whose id is divisible by 100."""
    rows = _table(spark, sf, "embeddings").where(F.col("vec_id") % 100 == 0)
    return rows.select(F.col("vec_id").alias("query_id"), "embedding")


@query
def vector_topk(spark, sf):
    return vectors.top_k(_table(spark, sf, "embeddings"), _asked(spark, sf), k=10)


@query
def vector_topk_centres(spark, sf):
    return vectors.top_k(_table(spark, sf, "embeddings"), _label_centres(spark, sf), k=10)


@query
def vector_topk_lsh(spark, sf):
    return vectors.top_k_lsh(_table(spark, sf, "embeddings"), _asked(spark, sf), k=10, exact_if_cheaper=False)


@query
def vector_topk_cells(spark, sf):
    stored = _table(spark, sf, "embeddings")
    index = cells.CellIndex.write(stored, f"{scratch_folder(spark)}/cells-{uuid.uuid4().hex}", k=10)
    return index.search(_asked(spark, sf), k=10)


# ---- conversations -----------------------------------------------------------


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations")
    return conversations.saved_messages(turns, at_most=turns.count())


@query
def conversation_save(spark, sf):
    return _messages(spark, sf)


@query
def conversation_system(spark, sf):
    return conversations.system_messages(_table(spark, sf, "conversations"))


@query
def conversation_load(spark, sf):
    turns = _table(spark, sf, "conversations")
    return conversations.loaded(_messages(spark, sf), conversations.system_messages(turns))


@query
def conversation_has_history(spark, sf):
    return conversations.has_history(_table(spark, sf, "conversations"))


# ---- telemetry ---------------------------------------------------------------


@query
def usage_totals(spark, sf):
    return telemetry.usage_totals(_usage_events(spark, sf))


@query
def chain_duration(spark, sf):
    events = _usage_events(spark, sf)
    return telemetry.chain_durations(events, at_most=events.count())


@query
def retriever_duration(spark, sf):
    events = _usage_events(spark, sf)
    return telemetry.retriever_durations(events, at_most=events.count())


@query
def usage_by_window(spark, sf):
    rows = telemetry.usage_by_window(_usage_events(spark, sf))
    day = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rows.select(day, "run", *telemetry.TOKENS, "n_ends")
