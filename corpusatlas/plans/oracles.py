"""The same results in plain SQL, by another method wherever there is one.

Links between code files are worked out from file numbers, not from paths: an
import with offset o leads to file k - o if that file exists and is a code file.
"""

from __future__ import annotations

from corpusatlas.sources.code_files import CODE_FILES_SQL

_FILES = f"""
code_files AS ({CODE_FILES_SQL.format(part="part")}),
f AS (SELECT k, k % 10 AS m, repo, path, repo || '/' || path AS abs_path, content FROM code_files)
"""

_EDGES = f"""{_FILES},
offs(pos, off, kind) AS (VALUES (0, 3, 'relative'), (1, 6, 'bare'), (2, 30, 'relative')),
imp AS (
  SELECT f.*, pos, kind, k - off AS j,
    CASE pos WHEN 0 THEN (k + 4) % 7 WHEN 1 THEN (k + 1) % 7 ELSE (k + 5) % 7 END AS pkg
  FROM f, offs WHERE m <= 5
),
edges AS (
  SELECT i.k, i.repo, i.path, i.abs_path, i.pos, i.kind,
    CASE WHEN i.kind = 'bare' THEN '@lib/' WHEN i.m = 5 THEN '../../' ELSE '../' END
      || 'pkg' || i.pkg || '/mod' || i.j AS specifier,
    CASE WHEN t.k IS NOT NULL THEN t.abs_path
         WHEN i.kind = 'bare' THEN '@lib/pkg' || i.pkg || '/mod' || i.j
         ELSE i.repo || '/src/pkg' || i.pkg || '/mod' || i.j END AS target,
    t.k IS NOT NULL AS resolved, i.kind = 'bare' AND t.k IS NULL AS is_external, t.k AS tk
  FROM imp i LEFT JOIN f t ON t.k = i.j AND t.m <= 5
  UNION ALL
  SELECT k, repo, path, abs_path, 3, 'bare', 'lodash', 'lodash', false, true, NULL
  FROM f WHERE m <= 5
),
assets AS (
  SELECT a.k, a.repo, a.path, a.abs_path, 4 AS pos, 'asset' AS kind, '' AS specifier,
    t.abs_path AS target, true AS resolved, false AS is_external, t.k AS tk
  FROM f a JOIN f t ON t.k = a.k + 6 WHERE a.m = 0
  UNION ALL
  SELECT a.k, a.repo, a.path, a.abs_path, 5, 'asset', '', t.abs_path, true, false, t.k
  FROM f a JOIN f t ON t.k = a.k + 9 WHERE a.m = 0
),
refs AS (SELECT * FROM edges UNION ALL SELECT * FROM assets),
inner_refs AS (SELECT * FROM refs WHERE resolved OR kind = 'relative')
"""

_EXT = """CASE WHEN m <= 5 THEN '.ts' WHEN m = 6 THEN '.html' WHEN m = 7 THEN '.json'
  WHEN m = 8 THEN '.yaml' ELSE '.scss' END"""
_TAG = """CASE WHEN m IN (6, 9) THEN 'ui' WHEN m IN (7, 8) THEN 'dataAccess'
  WHEN m = 5 THEN 'utility' ELSE 'feature' END"""


_PROMPTS = """
code AS (
  SELECT e.k, string_agg(coalesce(t.content, ''), chr(10) ORDER BY e.pos) AS related
  FROM inner_refs e LEFT JOIN f t ON t.k = e.tk GROUP BY e.k
), related AS (
  SELECT k, related FROM code
  UNION ALL SELECT t.k, i.content || chr(10) || s.content
  FROM f t JOIN f i ON i.k = t.k - 6 JOIN f s ON s.k = t.k + 3 WHERE t.m = 6
), made AS (
  SELECT f.k, repo, path, m, 'Main file' || chr(10) || 'Name: ' || abs_path || chr(10) ||
    'Content:' || chr(10) || content || chr(10) || chr(10) || 'Related files:' || chr(10) ||
    coalesce(nullif(r.related, ''), 'Not Applicable Here') || chr(10) || chr(10) ||
    'Compiled text:' || chr(10) || 'Not Applicable Here' || chr(10) AS prompt
  FROM f LEFT JOIN related r ON r.k = f.k WHERE m <= 8
)"""


def _tokens(column: str) -> str:
    return rf"CAST(len(regexp_extract_all({column}, '[^ \n\t\r]+')) AS BIGINT)"


_TOKEN_LIST = r"regexp_extract_all(text, '(?:^[ \n\t\r]+)?[^ \n\t\r]+[ \n\t\r]*')"
_SENTENCES = r"""list_transform(list_sort(list_transform(
  regexp_extract_all(text, '[^.!?\n]*[^.!? \n\t\r][^.!?\n]*[.!?]?'),
  lambda s, i: {'k': -len(regexp_extract_all(s, '[^ \n\t\r]+')), 'i': i, 's': trim(s)})), lambda x: x.s)"""

_RECORD = """
'{"repository":"' || repo || '","fileName":"' || abs_path || '",' ||
CASE WHEN m <= 5 THEN
  '"imports":' || targets || ',"functions":[{"name":"fn' || k ||
  '","parameters":[{"name":"a","type":"string"},{"name":"b","type":"number"}],"returnType":"void"}],"classes":[' ||
  CASE WHEN m = 0 THEN '{"name":"C' || k || '","decorators":[{"name":"Component","arguments":[' ||
    to_json('{' || chr(10) || '  templateUrl: ''../pkg' || ((k + 6) % 7) || '/mod' || (k + 6) || '.html'','
      || chr(10) || '  styleUrls: [''../pkg' || ((k + 9) % 7) || '/mod' || (k + 9) || '.scss''],'
      || chr(10) || '}') ||
    ']}],"methods":[{"name":"run","parameters":[{"name":"x","type":"string"}],"returnType":"void","decorators":[]}]}'
    ELSE '' END || '],"interfaces":[' ||
  CASE WHEN m = 1 THEN '{"name":"I' || k ||
    '","properties":[{"name":"id","type":"number"},{"name":"name","type":"string"}]}' ELSE '' END ||
  '],"sourceCode":' || to_json(content)
WHEN m = 6 THEN '"tags":[]'
WHEN k % 20 = 7 THEN '"json":{"k":' || k || '}'
ELSE '"json":{}' END || '}'
"""

_TARGETS = """
targets AS (
  SELECT k, '[' || string_agg('"' || target || '"', ',' ORDER BY pos) || ']' AS targets,
    string_agg(target, ',' ORDER BY pos) AS plain
  FROM refs GROUP BY k
)"""

_ANSWERS = """
answers AS (
  SELECT doc_id, n_chars, text, doc_id % 8 AS form,
    '{"fileDescription": "' || said || '", "tag": "feature"' AS plain, said
  FROM (SELECT *, regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g') AS said FROM documents) d
)"""
_ERRORS = """CASE form WHEN 0 THEN '' WHEN 1 THEN 'fileDescription' WHEN 2 THEN 'tag' WHEN 3 THEN 'json'
  WHEN 4 THEN 'json' WHEN 5 THEN 'businessLogic.workflows' WHEN 6 THEN '' ELSE 'fileDescription' END"""

_OPEN_TAG = r"""<([A-Za-z][^ \t\r\n/>]*)((?:[^>"'']|"[^"]*"|''[^'']*'')*)>"""
_ATTRIBUTE = (
    r"""([^ \t\r\n"''>/=]+)(?:[ \t\r\n]*=[ \t\r\n]*(?:"([^"]*)"|''([^'']*)''|([^ \t\r\n"''=<>`]+)))?"""
)


def _markup() -> str:
    html = r"regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
    for name in ("script", "style", "title", "textarea"):
        html = rf"regexp_replace({html}, '(?is)(<{name}\b[^>]*>).*?</{name}[ \t\r\n]*>', '\1', 'g')"
    return html


_DECODED = "v"
for _reference, _character in (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"),
):
    _DECODED = f"replace({_DECODED}, '{_reference}', '{_character}')"

_USAGE = """
usage AS (
  SELECT user_id AS run, event_id, ts, event_type,
    CAST(json_extract(props, '$.k') AS BIGINT) AS c, CAST(floor(value) AS BIGINT) AS p
  FROM events
)"""

ORACLES: dict[str, str] = {
    "manifest_scan": f"""WITH {_FILES}
SELECT repo, path, abs_path, {_EXT} AS ext,
  CASE WHEN m = 5 THEN 'index.ts' ELSE 'mod' || k || {_EXT} END AS basename FROM f""",
    "manifest_union_repos": f"""WITH {_FILES}
SELECT repo, abs_path FROM f
UNION ALL SELECT '/r/pages', '/r/pages/page' || page_id || '.html' FROM pages
UNION ALL SELECT '/r/' || source, '/r/' || source || '/' || lang || '/' || doc_id || '.txt' FROM documents""",
    "content_or_empty": f"""WITH {_FILES}
SELECT repo, path, CASE WHEN m = 8 THEN '' ELSE content END AS content, m <> 8 AS read_ok FROM f""",
    "log_line_format": """SELECT event_id,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ' ' || l || ': ' || msg AS line, l AS level, msg AS message
FROM (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS l,
  event_type || ' ' || props AS msg FROM events) e""",
    "exclude_projects": f"""WITH {_FILES}
SELECT repo, path FROM f WHERE k % 7 <> 3 AND NOT starts_with(CAST(k AS VARCHAR), '1')""",
    "exclude_many_names": f"""WITH {_FILES}
SELECT repo, path FROM f JOIN part ON p_partkey = k WHERE m = 5 OR p_size >= 20""",
    "path_extension": f"WITH {_FILES} SELECT repo, path, {_EXT} AS ext FROM f",
    "eligible_files": f"WITH {_FILES} SELECT repo, path, {_EXT} AS ext FROM f WHERE m <= 8",
    "pending_files": f"""WITH {_FILES}
SELECT repo, path FROM f JOIN part ON p_partkey = k WHERE m <= 8 AND NOT p_size < 25""",
    "normalize_path": f"""WITH {_FILES}
SELECT repo, path, abs_path AS normalized, '/' || path AS above_root FROM f""",
    "path_parts": f"""WITH {_FILES}
SELECT repo, path, 'app' || (k % 3) AS repo_name,
  CASE WHEN m = 5 THEN 'index.ts' ELSE 'mod' || k || {_EXT} END AS file_name,
  'src/pkg' || (k % 7) || CASE WHEN m = 5 THEN '/mod' || k ELSE '' END AS folder FROM f""",
    "context_kind": f"""WITH {_FILES}
SELECT repo, path, CASE WHEN m <= 5 THEN 'code' WHEN m = 6 THEN 'template'
  WHEN m <= 8 THEN 'data' END AS kind FROM f""",
    "repos_with_marker": f"""WITH {_FILES}
SELECT DISTINCT repo FROM f WHERE path = 'src/pkg0/mod7.json'""",
    "import_specifiers": f"WITH {_EDGES} SELECT repo, path, pos, specifier FROM edges",
    "resolve_relative_imports": f"""WITH {_EDGES}
SELECT repo, path, pos, specifier, target, resolved FROM edges WHERE kind = 'relative'""",
    "resolve_alias_imports": f"""WITH {_EDGES}
SELECT repo, path, pos, specifier, target, resolved FROM edges WHERE kind = 'bare'""",
    "resolve_imports_all": f"""WITH {_EDGES}
SELECT repo, path, pos, specifier, target, resolved, is_external FROM edges""",
    "augment_imports": f"WITH {_EDGES} SELECT repo, path, pos, kind, target, resolved FROM refs",
    "decorator_assets": f"""WITH {_FILES}
SELECT repo, path, n AS asset_no, CASE n
  WHEN 0 THEN '../pkg' || ((k + 6) % 7) || '/mod' || (k + 6) || '.html'
  ELSE '../pkg' || ((k + 9) % 7) || '/mod' || (k + 9) || '.scss' END AS asset
FROM f, (VALUES (0), (1)) v(n) WHERE m = 0""",
    "extract_functions": f"""WITH {_FILES}
SELECT repo, path, 'fn' || k AS name, 'void' AS return_type, n AS param_no,
  p AS param_name, t AS param_type
FROM f, (VALUES (0, 'a', 'string'), (1, 'b', 'number')) v(n, p, t) WHERE m <= 5""",
    "extract_classes": f"""WITH {_FILES}
SELECT repo, path, 'C' || k AS class_name, 'run' AS method, 'void' AS return_type,
  'x' AS param_name, 'string' AS param_type FROM f WHERE m = 0""",
    "extract_decorators": f"""WITH {_FILES}
SELECT repo, path, 'C' || k AS class_name, 'Component' AS decorator, 0 AS arg_no,
  regexp_extract(content, '@Component\\(([^)]*)\\)', 1) AS argument FROM f WHERE m = 0""",
    "extract_method_decorators": """
SELECT doc_id, 'D' || doc_id AS class_name, 1 AS n_class_decorators, 'on' || doc_id AS method,
  'Promise<Map<string, number>>' AS return_type,
  '[{"name":"event","type":"Event"},{"name":"deep","type":"string"}]' AS parameters,
  CAST(dn AS INTEGER) AS decorator_no, decorator, CAST(an AS INTEGER) AS argument_no,
  CASE an WHEN 0 THEN chr(39) || source || chr(39) WHEN 1 THEN '[''$event'']' END AS argument
FROM documents, (VALUES (0, 'Input', NULL), (1, 'HostListener', 0), (1, 'HostListener', 1)) v(dn, decorator, an)
UNION ALL SELECT doc_id, 'D' || doc_id, 1, 'empty', NULL, '[]', NULL, NULL, NULL, NULL FROM documents
UNION ALL SELECT doc_id, 'Empty', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents""",
    "extract_deep_types": """
SELECT doc_id, 'I' || doc_id AS name, CAST(n AS INTEGER) AS prop_no, p AS prop_name,
  CASE n WHEN 0 THEN repeat('{ a: ', doc_id % 40 + 1) || 'string' || repeat(' }', doc_id % 40 + 1)
    ELSE repeat('(x: ', doc_id % 40 + 1) || 'y' || repeat(') => void', doc_id % 40 + 1) END AS prop_type
FROM documents, (VALUES (0, 'id'), (1, 'call')) v(n, p)""",
    "extract_interfaces": f"""WITH {_FILES}
SELECT repo, path, 'I' || k AS name, n AS prop_no, p AS prop_name, t AS prop_type
FROM f, (VALUES (0, 'id', 'number'), (1, 'name', 'string')) v(n, p, t) WHERE m = 1""",
    "html_tag_counts": f"""
SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all({_markup()}, '{_OPEN_TAG}', 1)) AS tag FROM pages
) t GROUP BY 1, 2""",
    "html_tag_attrs": f"""
WITH found AS (
  SELECT page_id, regexp_extract_all({_markup()}, '{_OPEN_TAG}', 1) AS names,
    regexp_extract_all({_markup()}, '{_OPEN_TAG}', 2) AS texts FROM pages
), tags AS (
  SELECT page_id, unnest(range(len(names))) AS n, unnest(names) AS tag, unnest(texts) AS a FROM found
), attrs AS (
  SELECT page_id, n, tag, unnest(range(len(regexp_extract_all(a, '{_ATTRIBUTE}')))) AS i,
    unnest(regexp_extract_all(a, '{_ATTRIBUTE}', 1)) AS attr,
    unnest(regexp_extract_all(a, '{_ATTRIBUTE}', 2)) AS v2,
    unnest(regexp_extract_all(a, '{_ATTRIBUTE}', 3)) AS v3,
    unnest(regexp_extract_all(a, '{_ATTRIBUTE}', 4)) AS v4 FROM tags
)
SELECT page_id, CAST(n AS INTEGER) AS tag_no, lower(tag) AS tag, lower(attr) AS attr,
  {_DECODED} AS value
FROM (SELECT *, concat(v2, v3, v4) AS v FROM attrs) x
QUALIFY row_number() OVER (PARTITION BY page_id, n, lower(attr) ORDER BY i) = 1""",
    "tolerant_json": f"""WITH {_FILES}
SELECT repo, path, k % 20 = 7 AS parse_ok, CASE WHEN k % 20 = 7 THEN k END AS k FROM f WHERE m = 7""",
    "tolerant_json_props": """SELECT event_id, json_valid(props) AS parse_ok,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
    "file_record": f"""WITH {_EDGES}, {_TARGETS}
SELECT f.repo AS repository, f.abs_path AS "fileName", t.plain AS imports,
  CASE WHEN m <= 5 THEN 'fn' || f.k END AS functions,
  CASE WHEN m = 0 THEN 'C' || f.k WHEN m <= 5 THEN '' END AS classes,
  CASE WHEN m = 1 THEN 'I' || f.k WHEN m <= 5 THEN '' END AS interfaces,
  CASE WHEN m = 6 THEN CAST(0 AS BIGINT) END AS n_tags,
  CASE WHEN m = 7 THEN CASE WHEN f.k % 20 = 7 THEN '{{"k":' || f.k || '}}' ELSE '{{}}' END END AS json,
  CASE WHEN m <= 5 THEN content END AS "sourceCode"
FROM f LEFT JOIN targets t ON t.k = f.k WHERE m <= 7""",
    "internal_edges": f"WITH {_EDGES} SELECT repo, path, pos, target FROM inner_refs",
    "dependency_pieces": f"""WITH {_EDGES}, texts AS (
  SELECT e.abs_path, e.pos, CASE WHEN row_number() OVER (PARTITION BY e.abs_path ORDER BY e.pos) = 1 THEN '' ELSE chr(10) END
    || coalesce(t.content, '') AS whole FROM inner_refs e LEFT JOIN f t ON t.k = e.tk
), cuts AS (
  SELECT abs_path, pos, i, substr(whole, i * 64 + 1, 64) AS text
  FROM (SELECT *, unnest(range((length(whole) + 63) // 64)) AS i FROM texts) every
)
SELECT abs_path, row_number() OVER (PARTITION BY abs_path ORDER BY pos, i) - 1 AS piece_no, text FROM cuts""",
    "dependency_context": f"""WITH {_EDGES}
SELECT e.abs_path, string_agg(coalesce(t.content, ''), chr(10) ORDER BY e.pos) AS related,
  CAST(sum({_tokens("coalesce(t.content, '')")}) AS BIGINT) AS n_tokens
FROM inner_refs e LEFT JOIN f t ON t.k = e.tk GROUP BY e.abs_path""",
    "dependency_context_cut": f"""WITH {_EDGES}, whole AS (
SELECT e.abs_path, string_agg(coalesce(t.content, ''), chr(10) ORDER BY e.pos) AS related,
  CAST(sum({_tokens("coalesce(t.content, '')")}) AS BIGINT) AS n_tokens
FROM inner_refs e LEFT JOIN f t ON t.k = e.tk GROUP BY e.abs_path)
SELECT abs_path, CASE WHEN n_tokens > 40 THEN substr(related, 1, 400) ELSE related END AS related,
  n_tokens FROM whole""",
    "template_importers": f"""WITH {_FILES}
SELECT t.abs_path AS template, i.abs_path AS importer FROM f t JOIN f i ON i.k = t.k - 6 WHERE t.m = 6""",
    "template_context": f"""WITH {_FILES}
SELECT t.abs_path AS template, i.content || chr(10) || s.content AS related,
  {_tokens("i.content")} + {_tokens("s.content")} AS n_tokens
FROM f t JOIN f i ON i.k = t.k - 6 JOIN f s ON s.k = t.k + 3 WHERE t.m = 6""",
    "prompt_assembly": f"""WITH {_EDGES}, {_PROMPTS}
SELECT repo, path,
  CASE WHEN m <= 5 THEN 'code' WHEN m = 6 THEN 'template' ELSE 'data' END AS context_kind,
  {_tokens("prompt")} AS n_tokens,
  CASE WHEN {_tokens("prompt")} > 120000 THEN substr(prompt, 1, 100000) ELSE prompt END AS prompt
FROM made""",
    "enrich_pending": f"""WITH {_EDGES}, {_PROMPTS}
SELECT repo, path, {_tokens("prompt")} AS n_tokens, {_TAG} AS tag, sha256(prompt) AS digest, 'valid' AS outcome
FROM made JOIN part ON p_partkey = k WHERE NOT p_size < 25""",
    "enrich_resumable": f"""WITH {_EDGES}, {_PROMPTS}
SELECT repo, path, (row_number() OVER (PARTITION BY repo ORDER BY path) - 1) // 50 AS batch_no,
  {_tokens("prompt")} AS n_tokens, {_TAG} AS tag, sha256(prompt) AS digest, 'valid' AS outcome, CAST(2 AS BIGINT) AS n_commits
FROM made""",
    "filter_graph_nodes": f"""WITH {_FILES}
SELECT repo, 'src/pkg' || (k % 7) AS project, count(*) AS n_files FROM f WHERE k % 7 <> 3 GROUP BY 1, 2""",
    "filter_graph_edges": f"""WITH {_EDGES}
SELECT repo, 'src/pkg' || (k % 7) AS src, 'src/pkg' || (tk % 7) AS dst, count(*) AS n_imports
FROM refs WHERE resolved AND k % 7 <> 3 AND k % 7 <> tk % 7 GROUP BY 1, 2, 3""",
    "batch_assignment": f"""WITH {_FILES}
SELECT repo, path, (row_number() OVER (PARTITION BY repo ORDER BY path) - 1) // 50 AS batch_no
FROM f WHERE m <= 8""",
    "summary_upsert": """
SELECT doc_id, coalesce(n.tag, e.tag) AS tag,
  CAST(CASE WHEN n.tag IS NULL THEN 0 ELSE 1 END AS INTEGER) AS batch_id
FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'feature' ELSE 'utility' END AS tag FROM labels) e
FULL OUTER JOIN (SELECT doc_id, 'ui-' || source AS tag FROM documents) n USING (doc_id)""",
    "summary_merge": """
SELECT doc_id, coalesce(n.tag, e.tag) AS tag,
  CAST(CASE WHEN n.tag IS NULL THEN 0 WHEN doc_id % 100 = 0 THEN 2 ELSE 1 END AS INTEGER) AS batch_id
FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'feature' ELSE 'utility' END AS tag FROM labels) e
FULL OUTER JOIN (SELECT doc_id, 'ui-' || source AS tag FROM documents) n USING (doc_id)""",
    "refine_passes": f"""
WITH s AS (
  SELECT doc_id, lang, text, {_SENTENCES} AS sentences FROM documents
)
SELECT doc_id, concat_ws(' ', sentences[1], sentences[2], sentences[3]) AS description,
  CASE lang WHEN 'en' THEN 'feature' WHEN 'fr' THEN 'ui' WHEN 'de' THEN 'dataAccess' ELSE 'utility' END AS tag,
  {_tokens("text")} AS tokens, CAST(len(sentences) AS BIGINT) AS sentences,
  CASE WHEN contains(text, coalesce(sentences[1], '')) THEN 'yes' ELSE 'no' END
    || ', in ' || length(text) || ' characters' AS verification
FROM s""",
    "verify_pass": f"""
WITH s AS (SELECT doc_id, text, coalesce({_SENTENCES}[1], '') AS said FROM documents)
SELECT doc_id, 'Does the file say: ' || said AS questions,
  CASE WHEN contains(text, said) THEN 'yes' ELSE 'no' END || ', in ' || length(text) || ' characters' AS answers
FROM s""",
    "validate_summary": f"""WITH {_ANSWERS}
SELECT doc_id, form IN (0, 6) AS valid, {_ERRORS} AS errors FROM answers""",
    "repair_summary": f"""WITH {_ANSWERS}
SELECT doc_id, CASE form WHEN 1 THEN '{{"tag": "ui"}}'
    WHEN 2 THEN '{{"fileDescription": "' || said || '", "tag": "other"}}'
    WHEN 4 THEN plain || '}}' WHEN 5 THEN plain || ', "businessLogic": {{"rules": "r"}}}}'
    WHEN 7 THEN '{{"fileDescription": ' || n_chars || ', "tag": "ui"}}' END AS repaired,
  form = 4 AS valid
FROM answers WHERE form NOT IN (0, 6)""",
    "enrichment_outcome": f"""WITH {_ANSWERS}
SELECT doc_id,
  CASE WHEN form IN (0, 6) THEN 'valid' WHEN form = 4 THEN 'repaired' ELSE 'quarantine' END AS outcome,
  CASE form WHEN 0 THEN plain || '}}' WHEN 4 THEN plain || '}}'
    WHEN 6 THEN plain || ', "flowDescription": {{"initialization": "i", "processingSteps": ["a"]}}}}' END AS summary,
  CASE WHEN form NOT IN (0, 4, 6) THEN {_ERRORS} END AS reason
FROM answers""",
    "repo_summary": f"""WITH {_EDGES}, files AS (
  SELECT repo, count(*) AS n_files, count(*) FILTER (m <= 5) AS n_code,
    count(*) FILTER (m = 6) AS n_template, count(*) FILTER (m IN (7, 8)) AS n_data,
    count(*) FILTER (m = 9) AS n_style FROM f GROUP BY repo
), linked AS (
  SELECT repo, count(*) AS n_references, count(*) FILTER (resolved) AS n_resolved,
    count(*) FILTER (is_external) AS n_external, count(DISTINCT tk) AS n_targets FROM refs GROUP BY repo
), degree AS (
  SELECT repo, max(d) AS max_in_degree FROM
    (SELECT repo, tk, count(*) AS d FROM refs WHERE resolved GROUP BY repo, tk) x GROUP BY repo
)
SELECT * FROM files JOIN linked USING (repo) JOIN degree USING (repo)""",
    "repo_tag_rollup": f"""WITH {_FILES}
SELECT repo, tag, count(*) AS n_files, CAST(grouping(repo, tag) AS INTEGER) AS level
FROM (SELECT repo, {_TAG} AS tag FROM f) t GROUP BY ROLLUP (repo, tag)""",
    "catalogue_lookup": f"""WITH {_FILES}
SELECT repo AS repository, abs_path AS "fileName" FROM f WHERE repo = '/r/app0' AND m <= 5""",
    "catalogue_postings": f"""WITH {_FILES}
SELECT repo AS repository, abs_path AS "fileName" FROM f WHERE m = 0 AND k < 400 AND k % 4 = 0""",
    "document_store_roundtrip": f"""WITH {_FILES}
SELECT sha256('app' || (k % 3) || chr(10) || path || chr(10) || '0') AS chunk_id,
  'file-path: ' || path || chr(10) || chr(10) || '    ' || content || chr(10) || '    ' AS text, path AS source,
  CAST(len(embedding) AS BIGINT) AS n_dims FROM f LEFT JOIN embeddings ON vec_id = k""",
    "docs_from_files": f"""WITH {_FILES}
SELECT 'app' || (k % 3) AS repository, repo AS "repositoryUrl", path AS source, 0 AS chunk_no,
  'file-path: ' || path || chr(10) || chr(10) || '    ' || content || chr(10) || '    ' AS text FROM f""",
    "docs_from_records": f"""WITH {_EDGES}, {_TARGETS}
SELECT 'app' || (k % 3) AS repository, abs_path AS source, 0 AS chunk_no, {_RECORD} AS text
FROM f LEFT JOIN targets USING (k) WHERE m <= 7""",
    "chunk_documents": f"""
WITH t AS (SELECT doc_id, unnest(range(len({_TOKEN_LIST}))) AS i, unnest({_TOKEN_LIST}) AS tok FROM documents)
SELECT doc_id, CAST(i // 250 AS INTEGER) AS chunk_no, string_agg(tok, '' ORDER BY i) AS text
FROM t GROUP BY 1, 2""",
    "chunk_overlap": f"""
WITH t AS (SELECT doc_id, unnest(range(len({_TOKEN_LIST}))) AS i, unnest({_TOKEN_LIST}) AS tok FROM documents),
placed AS (
  SELECT doc_id, i, tok, i // 200 AS chunk_no FROM t
  UNION ALL
  SELECT doc_id, i, tok, i // 200 - 1 FROM t WHERE i >= 200 AND i % 200 < 50
)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, string_agg(tok, '' ORDER BY i) AS text
FROM placed GROUP BY 1, 2""",
    "token_counts": f"SELECT doc_id, {_tokens('text')} AS n_tokens FROM documents",
    "size_guard": f"""SELECT doc_id, {_tokens('text')} AS n_tokens,
  CASE WHEN {_tokens('text')} > 300 THEN substr(text, 1, 1000) ELSE text END AS text FROM documents""",
    "size_tier_routing": f"""SELECT CASE WHEN n < 2000 THEN 'small' WHEN n < 26000 THEN 'middle'
  ELSE 'large' END AS tier, count(*) AS n_docs
FROM (SELECT {_tokens('text')} AS n FROM documents) d GROUP BY 1""",
    "tier_lookup": """
WITH modes(mode, model, large_context) AS (VALUES ('openai-std', 'gpt-4', false),
  ('azure-std', 'gpt-4-32k', true), ('gpt4turbo', 'gpt-4-1106-preview', true)),
langs(lang, mode) AS (VALUES ('en', 'openai-std'), ('de', 'azure-std'), ('fr', 'gpt4turbo'))
SELECT doc_id, coalesce(l.mode, 'other') AS mode, coalesce(model, 'gpt-4-1106-preview') AS model,
  coalesce(large_context, false) AS large_context
FROM documents d LEFT JOIN langs l ON l.lang = d.lang LEFT JOIN modes m ON m.mode = l.mode""",
    "escape_braces": """SELECT doc_id,
  '{{' || lang || '}} ' || replace(replace(text, '{', '{{'), '}', '}}') AS escaped FROM documents""",
    "vector_topk": """
WITH scored AS (
  SELECT q.vec_id AS query_id, e.vec_id,
    round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, similarity FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id)
QUALIFY row_number() OVER w <= 10""",
    "vector_topk_centres": """
WITH parts AS (
  SELECT CAST(label AS BIGINT) AS query_id, unnest(range(len(embedding))) AS pos,
    unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
), means AS (SELECT query_id, pos, avg(v) AS v FROM parts GROUP BY 1, 2),
centres AS (SELECT query_id, list(v ORDER BY pos) AS c FROM means GROUP BY 1),
scored AS (
  SELECT query_id, vec_id,
    round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS similarity
  FROM embeddings, centres
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, similarity FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id)
QUALIFY row_number() OVER w <= 10""",
    "conversation_save": """SELECT conv_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text
FROM conversations WHERE role <> 'system'""",
    "conversation_system": """
SELECT c.conv_id, s.text AS system_message FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, text FROM conversations WHERE role = 'system'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) s USING (conv_id)""",
    "conversation_load": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text
FROM conversations WHERE role <> 'system'
UNION ALL
SELECT conv_id, -1, 'system', text FROM conversations WHERE role = 'system' AND text <> ''
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
    "conversation_has_history": """SELECT conv_id,
  count(*) FILTER (role <> 'system' OR text <> '') > 0 AS has_history FROM conversations GROUP BY 1""",
    "usage_totals": f"""WITH {_USAGE}
SELECT run, CAST(coalesce(sum(c) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(p) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(c + p) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS total_tokens
FROM usage GROUP BY run""",
    "chain_duration": f"""WITH {_USAGE},
first_model AS (SELECT run, min(ts) AS ts FROM usage WHERE event_type = 'error' GROUP BY run),
paired AS (
  SELECT e.run, e.event_id, e.ts, s.ts AS chain_ts FROM (SELECT * FROM usage WHERE event_type = 'purchase') e
  ASOF LEFT JOIN (SELECT * FROM usage WHERE event_type = 'view') s ON s.run = e.run AND e.ts >= s.ts
)
SELECT p.run, event_id, CAST(date_diff('microsecond', coalesce(chain_ts, m.ts), p.ts) AS DOUBLE) / 1000000
  AS duration_sec
FROM paired p LEFT JOIN first_model m ON m.run = p.run AND m.ts <= p.ts""",
    "retriever_duration": f"""WITH {_USAGE}
SELECT e.run, e.event_id, CAST(date_diff('microsecond', s.ts, e.ts) AS DOUBLE) / 1000000 AS duration_sec
FROM (SELECT * FROM usage WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT * FROM usage WHERE event_type = 'signup') s ON s.run = e.run AND e.ts >= s.ts""",
    "usage_by_window": f"""WITH {_USAGE}
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, run,
  CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p) AS BIGINT) AS prompt_tokens,
  CAST(sum(c + p) AS BIGINT) AS total_tokens, count(*) AS n_ends
FROM usage WHERE event_type = 'purchase' GROUP BY 1, 2""",
}
# What was written comes back.
ORACLES["catalogue_roundtrip"] = ORACLES["file_record"]
ORACLES["repo_rollup_merged"] = f"""
SELECT repo, n_files, n_code, n_references, n_resolved, n_external, true AS targets_within_error
FROM ({ORACLES["repo_summary"]}) whole"""
