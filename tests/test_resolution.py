import pytest
from pyspark.sql import functions as F

from corpusatlas.functions import paths
from corpusatlas.operators import context, graph, imports, manifest, records
from corpusatlas.operators.imports import AliasRule
from corpusatlas.session import materialise
from corpusatlas.sources.code_files import located

FILES = {
    "src/a.ts": "import x from './both';\nimport y from './only';\nimport z from './gone';\nimport w from './dir';\n"
    "import v from '../data.json';\n",
    "src/both.ts": "BOTH",
    "src/both/index.ts": "INDEX",
    "src/only.ts": "",
    "src/dir/other.ts": "OTHER",
    "data.json": "{}",
    "lib/m.ts": "import p from '@x/p';\nimport q from '@x/q/r';\nimport s from 'exact';\nimport t from 'lib/m';\n"
    "import u from 'lib';\nimport n from 'npm';\nimport k from '/r/one/src/only';\nimport l from '../../two/z';\n",
    "first/p.ts": "P1",
    "second/p.ts": "P2",
    "second/q/r.ts": "QR",
    "lib/exact.ts": "E",
    "cmp/c.ts": "import b from 'npm';\n@Component({\n  templateUrl: './c.html',\n"
    "  styleUrls: ['./c.scss', './none.css'],\n})\n"
    "export class C {\n}\n@Two({\n  templateUrl: './d.html',\n})\nexport class D {\n}\n",
    "cmp/c.html": "<p></p>",
    "cmp/d.html": "<b></b>",
    "cmp/c.scss": "p { }",
}
RULES = [
    AliasRule("@x/*", ("first/*", "second/*")),
    AliasRule("exact", ("lib/exact",)),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("/r/one", p, c) for p, c in FILES.items()] + [("/r/two", "z.ts", "Z")]
    files = materialise(located(spark.createDataFrame(rows, "repo string, path string, content string")), "t")
    return files, manifest.scan(files.select("repo", "path"))


@pytest.fixture(scope="module")
def linked(corpus):
    files, listed = corpus
    edges = materialise(imports.resolve(imports.references(files), listed, RULES), "e")
    contents = files.select("abs_path", "content")
    sizes = context.sizes(contents)
    whole = {r.owner: r for r in context.code_context(edges, contents, sizes).collect()}
    return edges, contents, sizes, whole


def targets(edges):
    return {(r.path, r.specifier): (r.target, r.resolved) for r in edges.collect()}


@pytest.mark.parametrize("split", [1_000_000, 1])
@pytest.mark.parametrize("form", ["rules", "arrays", "rows"])
def test_resolution(spark, corpus, split, form):
    files, listed = corpus
    rules = RULES
    if form == "arrays":
        rules = listed.select("repo").distinct().withColumn("aliases", imports.alias_column(RULES))
    if form == "rows":
        flat = [(repo, r.pattern, t, n, m) for repo in ("/r/one", "/r/two") for n, r in enumerate(RULES) for m, t in enumerate(r.targets)]
        rules = spark.createDataFrame(flat, "repo string, pattern string, target string, rule_no int, target_no int")
    got = targets(imports.resolve(imports.references(files), listed, rules, rows_per_split=split))
    a, m, c = "src/a.ts", "lib/m.ts", "cmp/c.ts"
    assert got[a, "./both"] == ("/r/one/src/both/index.ts", True)  # a folder's index comes first
    assert got[a, "./only"] == ("/r/one/src/only.ts", True)
    assert got[a, "./gone"] == ("/r/one/src/gone", False)
    assert got[a, "./dir"] == ("/r/one/src/dir", False)  # a folder without index
    assert got[a, "../data.json"] == ("/r/one/data.json", True)
    assert got[m, "@x/p"] == ("/r/one/first/p.ts", True)  # the first target that exists
    assert got[m, "@x/q/r"] == ("/r/one/second/q/r.ts", True)
    assert got[m, "exact"] == ("/r/one/lib/exact.ts", True)
    assert got[m, "lib/m"] == ("/r/one/lib/m.ts", True)  # from the base folder
    assert got[m, "lib"] == ("/r/one/lib", True)  # a folder counts there
    assert got[m, "npm"] == ("npm", False)
    assert got[m, "/r/one/src/only"] == ("/r/one/src/only.ts", True)
    assert got[m, "../../two/z"] == ("/r/two/z.ts", True)  # leads out of its repository
    assert got[c, "./c.html"] == ("/r/one/cmp/c.html", True)
    assert got[c, "./d.html"] == ("/r/one/cmp/d.html", True)  # assets of every decorator
    assert got[c, "./none.css"] == ("./none.css", False)
    assert len(got) == 5 + 8 + 5


def test_ten_thousand_rules_for_each_repository(spark):
    """Rules meet names by prefix; no array of rules travels with a name."""
    rows = [(repo, f"src/m{i}.ts", "") for repo in ("/a", "/b") for i in range(20)]
    rows += [(repo, "src/use.ts", "".join(f"import x from '@p{i}/m{i % 20}';\n" for i in range(0, 10_000, 500)) + "import y from '@p7';\n") for repo in ("/a", "/b")]
    files = located(spark.createDataFrame(rows, "repo string, path string, content string"))
    listed = manifest.scan(files.select("repo", "path"))
    per_repo = spark.range(10_000).select(
        F.explode(F.array(F.lit("/a"), F.lit("/b"))).alias("repo"), F.concat(F.lit("@p"), F.col("id").cast("string"), F.lit("/*")).alias("pattern"),
        F.lit("src/*").alias("target"), F.col("id").alias("rule_no"), F.lit(0).alias("target_no"),
    )
    edges = imports.resolve(imports.references(files), listed, per_repo)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "_aliases" not in plan and "NestedLoop" not in plan
    got = {(r.repo, r.specifier): (r.target, r.resolved) for r in edges.collect()}
    assert len(got) == 42
    assert all(got[repo, f"@p{i}/m{i % 20}"] == (f"{repo}/src/m{i % 20}.ts", True) for repo in ("/a", "/b") for i in range(0, 10_000, 500))
    assert got["/a", "@p7"] == ("@p7", False)


def test_first_fitting_rule_with_a_file_wins(spark):
    rows = [("/r", "one/a.ts", ""), ("/r", "two/a.ts", ""), ("/r", "two/b.ts", ""), ("/r", "u.ts", "import a from 'x/y/a';\nimport b from 'x/y/b';\nimport c from 'x/c-end';\nimport d from 'anything';\n"), ("/r", "three/c.ts", ""), ("/r", "any/anything.ts", "")]
    files = located(spark.createDataFrame(rows, "repo string, path string, content string"))
    rules = [AliasRule("x/*", ("none/*", "one/a")), AliasRule("x/y/*", ("two/*",)), AliasRule("x/*-end", ("three/*",)), AliasRule("*", ("any/*",))]
    got = targets(imports.resolve(imports.references(files), manifest.scan(files.select("repo", "path")), rules))
    assert got["u.ts", "x/y/a"] == ("/r/one/a.ts", True)  # the first rule, by its second target
    assert got["u.ts", "x/c-end"] == ("/r/one/a.ts", True)
    assert got["u.ts", "anything"] == ("/r/any/anything.ts", True)


@pytest.mark.parametrize("split", [1_000_000, 1])
def test_contexts(corpus, linked, split):
    _, listed = corpus
    edges, contents, sizes, _ = linked
    code = {
        r.owner: r.related
        for r in context.code_context(edges, contents, sizes, rows_per_split=split).collect()
    }
    # Unresolved places inside the repository read as empty, as a failed read does.
    assert code["/r/one/src/a.ts"] == "INDEX\n\n\n\n{}"
    assert code["/r/one/cmp/c.ts"] == "<p></p>\np { }\n<b></b>"
    html = {
        r.owner: r.related
        for r in context.template_context(
            edges, listed, contents, sizes, rows_per_split=split
        ).collect()
    }
    assert html["/r/one/cmp/c.html"] == FILES["cmp/c.ts"] + "\np { }"


@pytest.mark.parametrize("cut", [1, 5, 6, 7, 12])
@pytest.mark.parametrize("split", [1_000_000, 1])
def test_cut_before_gather_equals_cut_after(linked, cut, split):
    edges, contents, sizes, whole = linked
    part = context.code_context(edges, contents, sizes, limit=1, cut=cut, rows_per_split=split)
    for r in part.collect():
        full = whole[r.owner]
        assert r.n_tokens == full.n_tokens
        assert r.related == (full.related[:cut] if full.n_tokens > 1 else full.related)


@pytest.mark.parametrize("chars", [1, 3, 1_000])
def test_pieces_put_together_are_the_context(corpus, linked, chars):
    _, listed = corpus
    edges, contents, sizes, whole = linked
    templates = {r.owner: r.related for r in context.template_context(edges, listed, contents, sizes).collect()}
    for pieces, expected in (
        (graph.code_pieces(edges), {o: r.related for o, r in whole.items()}), (graph.template_pieces(edges, listed), templates),
    ):
        rows = context.in_pieces(pieces, contents, sizes, piece_chars=chars).collect()
        found = {}
        for r in sorted(rows, key=lambda r: (r.owner, r.piece_no)):
            assert 0 < len(r.text) <= chars and r.piece_no == len(found.get(r.owner, []))
            found.setdefault(r.owner, []).append(r.text)
        assert {o: "".join(t) for o, t in found.items()} == {o: t for o, t in expected.items() if t}


def test_an_owner_larger_than_any_row(spark):
    """One owner with far more text than a piece: rows stay small, and nothing gathers them."""
    contents = spark.range(120).select(F.concat(F.lit("/r/f"), F.col("id").cast("string")).alias("abs_path"), F.repeat(F.lit("0123456789"), 50_000).alias("content"))
    pieces = spark.range(120).select(F.lit("/r/own").alias("owner"), F.lit("s").alias("source"), F.col("id").cast("int").alias("place"), F.concat(F.lit("/r/f"), F.col("id").cast("string")).alias("piece"))
    made = context.in_pieces(pieces, contents, context.sizes(contents), piece_chars=1 << 16)
    sizes = made.agg(F.sum(F.length("text")).alias("all"), F.max(F.length("text")).alias("most"), F.count("*").alias("n"), F.max("piece_no").alias("last")).first()
    assert sizes["all"] == 120 * 500_000 + 119 and sizes.most == 1 << 16 and sizes.last == sizes.n - 1
    assert "collect_list" not in made._jdf.queryExecution().executedPlan().toString()


def test_prompts(corpus, linked):
    files, listed = corpus
    edges = linked[0]
    rows = {r.path: r for r in context.prompts(files, edges, listed).collect()}
    assert set(rows) == {p for p in FILES if not p.endswith(".scss")} | {"z.ts"}
    assert all(len(r.prompt.split()) == r.n_tokens for r in rows.values())
    assert "Related files:\nNot Applicable Here\n" in rows["data.json"].prompt
    assert "Content:\nBOTH\n\nRelated files:\nNot Applicable Here\n" in rows["src/both.ts"].prompt
    cut = {r.path: r for r in context.prompts(files, edges, listed, limit=20, cut=50).collect()}
    for path, row in rows.items():
        assert cut[path].prompt == (row.prompt[:50] if row.n_tokens > 20 else row.prompt)


def test_hot_template(spark):
    """One template named by every file: pieces are cut before anything is gathered."""
    rows = [("/r", f"a{i:04}.ts", f"@C({{\n  templateUrl: './t.html',\n}})\nclass A {{\n}}\n// {i}") for i in range(300)]
    rows.append(("/r", "t.html", "<p></p>"))
    files = materialise(located(spark.createDataFrame(rows, "repo string, path string, content string")), "hot")
    listed = manifest.scan(files.select("repo", "path"))
    edges = materialise(imports.resolve(imports.references(files), listed, rows_per_split=50), "e")
    contents = files.select("abs_path", "content")
    got = context.template_context(
        edges, listed, contents, context.sizes(contents), limit=100, cut=500, rows_per_split=20
    ).collect()
    text = "\n".join(c for _, p, c in sorted(rows, key=lambda r: r[1]) if p.endswith(".ts"))
    assert [(r.owner, r.related) for r in got] == [("/r/t.html", text[:500])]


def test_internal_needs_the_separator(spark):
    edges = spark.createDataFrame([("/r/app1", "/r/app10/x"), ("/r/app1", "/r/app1/x")], "repo string, target string")
    assert [r.target for r in graph.internal(edges).collect()] == ["/r/app1/x"]


def test_edge_exclusion(spark):
    edges = spark.createDataFrame([("aa", "b"), ("b", "aa"), ("c", "d")], "src string, dst string")
    assert graph.filter_edges(edges, ["a"]).count() == 2
    assert graph.filter_edges(edges, ["a"], targets_too=True).count() == 1
    assert graph.filter_edges(edges, []).count() == 3
    assert graph.filter_edges(edges, [f"n{i}" for i in range(99)] + ["c"]).count() == 2


def test_records_and_lookup(corpus, linked):
    rows = materialise(records.file_records(corpus[0], linked[0]).drop("json"), "r")
    by_name = {r.fileName: r for r in rows.collect()}
    c = by_name["/r/one/cmp/c.ts"]
    assert [x.name for x in c.classes] == ["C", "D"]
    assert c.imports == ["npm", "/r/one/cmp/c.html", "/r/one/cmp/c.scss", "./none.css", "/r/one/cmp/d.html"]
    assert [t.tag for t in by_name["/r/one/cmp/c.html"].tags] == ["p"]
    assert by_name["/r/one/src/both.ts"].imports == []

    def names(**example):
        return {r.fileName for r in records.lookup(rows, **example).collect()}

    assert names(classes=["D", "Z"]) == {"/r/one/cmp/c.ts"}
    assert names(tags=["b"], repository="/r/one") == {"/r/one/cmp/d.html"}
    assert names(imports=["npm"], file_name="/r/one/lib/m.ts") == {"/r/one/lib/m.ts"}
    assert names(functions=["f"]) == set()
    assert names(files=["/r/two/z.ts"]) == {"/r/two/z.ts"}
    assert len(names()) == rows.count()


def test_markers_content_and_kinds(spark, corpus):
    files, listed = corpus
    repos = listed.select("repo").distinct()
    assert [r.repo for r in manifest.repositories_with(repos, listed, "z.ts").collect()] == ["/r/two"]
    assert manifest.repositories_with(repos, listed, "src").count() == 0
    some = files.where("ext <> '.json'")
    missing = manifest.with_content(listed, some).where("not read_ok").collect()
    assert [(r.path, r.content) for r in missing] == [("data.json", "")]
    kinds = listed.select("path", manifest.context_kind(F.col("ext")).alias("k")).collect()
    assert {r.path: r.k for r in kinds}["cmp/c.scss"] is None
    done = files.where("path = 'data.json'")
    assert "data.json" not in {r.path for r in manifest.pending(listed, done).collect()}


def test_folders(spark):
    listed = manifest.scan(spark.createDataFrame([("/r", "a/b/c.ts"), ("/r", "i/index.ts")], "repo string, path string"))
    got = {(r.stem, r.probe): (r.target, r.is_file) for r in imports.existing_places(listed).collect()}
    assert got == {
        ("/r", 0): ("/r", False), ("/r/a", 0): ("/r/a", False), ("/r/a/b", 0): ("/r/a/b", False),
        ("/r/a/b/c.ts", 0): ("/r/a/b/c.ts", True), ("/r/a/b/c", 2): ("/r/a/b/c.ts", True),
        ("/r/i/index.ts", 0): ("/r/i/index.ts", True), ("/r/i", 1): ("/r/i/index.ts", True),
        ("/r/i/index", 2): ("/r/i/index.ts", True), ("/r/i", 0): ("/r/i", False),
    }
    assert spark.range(1).select(paths.dir_name(F.lit("/r"))).first()[0] == "/"
