"""Rules over source files, lock files, manifests and catalogs: files are made of whole tables' rows, and the SQL works out what each must give."""

from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.operators import integrity as I
from quarrylight.operators import joins as J
from quarrylight.operators import relational as R
from quarrylight.operators import rules
from quarrylight.plans.derived import pick
from quarrylight.registry import register
from quarrylight.session import table
from quarrylight.sources import catalog, repository

def _files(spark, sf_dir, path, text):
    """files(path, text) of all documents; both are SQL expressions over documents."""
    return table(spark, sf_dir, "documents").select(F.expr(path).alias("path"), F.expr(text).alias("text"))


def _lines(*lines):
    return "concat_ws('\\n', " + ", ".join(lines) + ")"


# ------------------------------------------------------------------ line, taint and statement rules

_SOURCE = f"concat('src/', lang, '/', doc_id, {pick('doc_id', repr('.py'), repr('.js'), repr('.sql'), repr('.cfg'))})"
_CODE = _lines(
    pick("doc_id", "'# app.run(debug=True)'", "'// el.innerHTML = req.query.x'", "'-- PREPARE s FROM q'", "'plain'"),
    pick("doc_id", "concat('  cur.execute(f\"SELECT ', doc_id, '\")')", "concat('el.innerHTML = req.query.x', doc_id)", "concat('EXEC (''a'' + @b', doc_id, ')')", "concat('DATABASE_URL=postgres://u:pw', doc_id, '@h/d?sslmode=disable')"),
    "CASE WHEN doc_id % 3 = 0 THEN 'csrf: false' ELSE 'x' END", "text",
)
_PATH_SQL = "'src/' || lang || '/' || doc_id || ['.py', '.js', '.sql', '.cfg'][doc_id % 4 + 1]"


@register("web_line_rules", f"""SELECT {_PATH_SQL} AS path, 2 AS line, {pick('doc_id', "'web.sql.dynamic_query'", "'web.xss.request_to_html'", "'database.sql.dynamic_exec'", "'web.database.connection_tls_disabled'")} AS rule, 'high' AS severity, [0.96, 0.95, 0.91, 0.96][doc_id % 4 + 1]::DOUBLE AS confidence,
['CWE-89', 'CWE-79', 'CWE-89', 'CWE-319'][doc_id % 4 + 1] AS cwe, {pick('doc_id', "'cur.execute(f\"SELECT ' || doc_id || '\")'", "'el.innerHTML = req.query.x' || doc_id", "'EXEC (''a'' + @b' || doc_id || ')'", "'DATABASE_URL=postgres://u:<redacted>@h/d?sslmode=disable'")} AS excerpt FROM documents
UNION ALL SELECT {_PATH_SQL}, 3, 'web.csrf.disabled', 'medium', 0.96::DOUBLE, 'CWE-352', 'csrf: false' FROM documents WHERE doc_id % 3 = 0""")  # fmt: skip
def web_line_rules(spark, sf_dir):
    """Findings with evidence in four kinds of files, behind a comment that must not fire and before each document's text."""
    return rules.line_findings(_files(spark, sf_dir, _SOURCE, _CODE)).select("path", "line", "rule", "severity", "confidence", "cwe", "excerpt")


@register("taint_rules", """WITH r AS (SELECT 'a/' || doc_id || '.py' AS path, doc_id % 50 AS n FROM documents)
SELECT path, 4 AS line, 'web.sql.tainted_variable_to_query' AS rule, 's' AS variable, 1 AS source_line, 'cur.execute(s)' AS excerpt FROM r UNION ALL SELECT path, 5 + n, 'web.sql.tainted_variable_to_query', 'q', 1, 'cur.execute(q)' FROM r WHERE 4 + n <= 40""")  # fmt: skip
def taint_rules(spark, sf_dir):
    """Request input through a second variable; a call in a comment; and one that comes up to 53 lines later."""
    text = _lines("'q = request.args[\"a\"]'", "'s = \"SELECT \" + q'", "'# cur.execute(s)'", "'cur.execute(s)'") + " || '\\n' || concat(repeat('pass\\n', cast(doc_id % 50 as int)), 'cur.execute(q)')"
    return rules.taint_findings(_files(spark, sf_dir, "concat('a/', doc_id, '.py')", text)).select("path", "line", "rule", "variable", "source_line", "excerpt")


_SCRIPT = "concat('-- DROP TABLE x;\\nDROP TABLE t', doc_id, ';\\n\\nUPDATE t SET a = ''WHERE;'' ;\\nDELETE FROM t WHERE id = ', doc_id, ';\\n/* ; */ PRAGMA foreign_keys = OFF;\\n', CASE WHEN doc_id % 2 = 0 THEN 'TRUNCATE b' ELSE 'SELECT 1' END)"


@register("sql_script_rules", """WITH d AS (SELECT doc_id || '.sql' AS path, doc_id FROM documents) SELECT path, 2 AS line, 'sql.destructive_ddl' AS rule, 'medium' AS severity FROM d UNION ALL SELECT path, 4, 'sql.unbounded_write', 'high' FROM d UNION ALL SELECT path, 6, 'sql.foreign_keys_off', 'high' FROM d
UNION ALL SELECT path, 7, 'sql.destructive_ddl', 'medium' FROM d WHERE doc_id % 2 = 0""")  # fmt: skip
def sql_script_rules(spark, sf_dir):
    return rules.sql_findings(_files(spark, sf_dir, "concat(doc_id, '.sql')", _SCRIPT)).select("path", "line", "rule", "severity")


@register("sql_statements", """SELECT doc_id || '.sql' AS path, unnest([2, 4, 5, 6, 7]) AS line, unnest(['DROP TABLE t' || doc_id, 'UPDATE t SET a = ''''', 'DELETE FROM t WHERE id = ' || doc_id, 'PRAGMA foreign_keys = OFF', CASE WHEN doc_id % 2 = 0 THEN 'TRUNCATE b' ELSE 'SELECT 1' END]) AS statement FROM documents""")
def sql_statements(spark, sf_dir):
    return rules.sql_statements(_files(spark, sf_dir, "concat(doc_id, '.sql')", _SCRIPT))


@register("prisma_rules", "SELECT 's' || doc_id || '.prisma' AS path, 2 AS line, 'prisma.literal_url' AS rule FROM documents WHERE doc_id % 2 = 0")
def prisma_rules(spark, sf_dir):
    text = "concat('datasource db {\\n  url = ', CASE WHEN doc_id % 2 = 0 THEN concat('\"postgres://h/', doc_id, '\"') ELSE 'env(\"X\")' END, '\\n}\\nmodel A {\\n  url = \"x\"\\n}')"
    return rules.prisma_findings(_files(spark, sf_dir, "concat('s', doc_id, '.prisma')", text))


@register("dockerfile_rules", """SELECT 'd' || doc_id || '/Dockerfile' AS path, unnest(CASE doc_id % 4 WHEN 0 THEN [1, 3] WHEN 1 THEN [1] WHEN 2 THEN [1, 1] ELSE [] END) AS line, unnest(CASE doc_id % 4 WHEN 0 THEN ['docker.mutable_image', 'docker.healthcheck_disabled'] WHEN 1 THEN ['docker.no_healthcheck'] WHEN 2 THEN ['docker.mutable_image', 'docker.no_healthcheck'] ELSE [] END) AS rule FROM documents""")
def dockerfile_rules(spark, sf_dir):
    text = pick("doc_id", "concat('FROM ', lang, ':Latest\\nRUN x\\nHEALTHCHECK NONE')", "concat('FROM a@sha256:', doc_id, ' AS b')", "concat('FROM ', source)", "concat('FROM scratch\\nHEALTHCHECK CMD ', lang)")
    return rules.dockerfile_findings(_files(spark, sf_dir, "concat('d', doc_id, '/Dockerfile')", text))


@register("compose_rules", """WITH d AS (SELECT 'c' || doc_id || '.yml' AS path, source, doc_id FROM documents)
SELECT path, source AS service, unnest(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'compose.mutable_image' END, CASE WHEN doc_id % 3 = 0 THEN 'compose.no_restart' END, CASE WHEN doc_id % 5 = 0 THEN 'compose.healthcheck_disabled' ELSE 'compose.no_healthcheck' END], lambda r: r IS NOT NULL)) AS rule FROM d""")  # fmt: skip
def compose_rules(spark, sf_dir):
    text = "concat('services:\\n  ', source, ':\\n    image: ', CASE WHEN doc_id % 2 = 0 THEN 'nginx' ELSE 'pg:1.2' END, ' # c\\n', CASE WHEN doc_id % 3 = 0 THEN '    restart: \"no\"\\n' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '    healthcheck:\\n      disable: true\\n' ELSE '' END, '  ok:\\n    image: x:1\\n    healthcheck:\\n      test: [\"CMD\"]\\nvolumes:\\n  v:\\n    image: x\\n')"
    return rules.compose_findings(_files(spark, sf_dir, "concat('c', doc_id, '.yml')", text)).select("path", "service", "rule")


# ------------------------------------------------------------------ symbols, imports, routes, references

_MODULE = "CASE WHEN doc_id % 2 = 0 THEN concat('import os\\nfrom a.m', doc_id, ' import c\\nclass C', doc_id, ':\\n    def f(self): pass\\n@app.get(''/x/', doc_id, ''')\\ndef g(): pass\\nimport pytest') ELSE concat('import x from ''./', lang, '''\\nexport class B', doc_id, ' {}\\nrouter.post(''/y/', doc_id, ''', f)\\nnew Foo(bar(', doc_id, ')); baz.qux(2); // no(1)') END"
_MODULE_PATH = "concat('p', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END)"
_MODULE_SQL = "'p' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.ts' END"


def _modules(spark, sf_dir):
    return _files(spark, sf_dir, _MODULE_PATH, _MODULE).withColumn("language", repository.language_of(F.col("path")))


@register("symbols_found", f"SELECT {_MODULE_SQL} AS path, unnest(CASE WHEN doc_id % 2 = 0 THEN ['class', 'def', 'def'] ELSE ['class'] END) AS kind, unnest(CASE WHEN doc_id % 2 = 0 THEN ['C' || doc_id, 'f', 'g'] ELSE ['B' || doc_id] END) AS name, unnest(CASE WHEN doc_id % 2 = 0 THEN [0, 4, 0] ELSE [0] END) AS indent FROM documents")
def symbols_found(spark, sf_dir):
    return rules.symbols(_modules(spark, sf_dir)).select("path", "kind", "name", "indent")


@register("imports_found", f"SELECT {_MODULE_SQL} AS path, unnest(CASE WHEN doc_id % 2 = 0 THEN ['os', 'a.m' || doc_id, 'pytest'] ELSE ['./' || lang] END) AS specifier FROM documents")
def imports_found(spark, sf_dir):
    return rules.imports(_modules(spark, sf_dir)).select("path", "specifier")


@register("routes_found", f"SELECT {_MODULE_SQL} AS path, CASE WHEN doc_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN doc_id % 2 = 0 THEN '/x/' || doc_id ELSE '/y/' || doc_id END AS template FROM documents")
def routes_found(spark, sf_dir):
    return rules.routes(_modules(spark, sf_dir)).select("path", "method", "template")


@register("references_found", f"SELECT {_MODULE_SQL} AS path, unnest(['Foo', 'bar']) AS name, unnest(['constructor', 'call']) AS kind FROM documents WHERE doc_id % 2 = 1")
def references_found(spark, sf_dir):
    return rules.references(_modules(spark, sf_dir)).select("path", "name", "kind")


#: (file, text, framework, evidence)
_TESTS = [
    ("a.py", "import unittest", "unittest", "test"), ("jest.config.js", "jest.mock(a)", "jest", "config"), ("a.spec.ts", "import {t} from \"vitest\"", "vitest", "test"), ("playwright.config.ts", "import x from \"@playwright/test\"", "playwright", "config"),
    ("a.cy.js", "cy.visit(a)", "cypress", "test"), ("ATest.java", "import org.junit.Test;", "junit", "test"), ("a_test.go", "func TestA(t *testing.T) {}", "go_test", "test"), ("lib.rs", "#[tokio::test]", "rust_test", "test"),
    ("test_q.py", "def test_a(): pass", "python_unknown", "test"), ("a.test.js", "it()", "javascript_unknown", "test"), ("ATests.java", "class A {}", "java_unknown", "test"), ("pytest.ini", "@pytest.mark", "pytest", "config"),
]
_of_tests = lambda k: f"[{', '.join(repr(t[k]) for t in _TESTS)}][doc_id % {len(_TESTS)} + 1]"


@register("test_frameworks_found", f"SELECT {_MODULE_SQL} AS path, 'pytest' AS framework, 'test' AS evidence FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 't' || doc_id || '/' || {_of_tests(0)}, {_of_tests(2)}, {_of_tests(3)} FROM documents")
def test_frameworks_found(spark, sf_dir):
    """The modules, and for every document a file of one of the other frameworks, a configuration or a test that names none."""
    others = _files(spark, sf_dir, "concat('t', doc_id, '/', " + pick("doc_id", *[repr(t[0]) for t in _TESTS]) + ")", "concat(" + pick("doc_id", *[f"'{t[1]}'" for t in _TESTS]) + ", '\\n// ', lang)")
    return rules.test_frameworks(_modules(spark, sf_dir).select("path", "text").unionByName(others)).select("path", "framework", "evidence")


@register("stack_profile", """WITH d AS (SELECT source AS root, doc_id % 4 AS k FROM documents) SELECT root, array_to_string(list_sort(list_distinct(list_filter(array_agg(CASE k WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Python' END), lambda x: x IS NOT NULL))), ',') AS languages,
array_to_string(list_sort(list_distinct(list_filter(array_agg(CASE k WHEN 0 THEN 'npm' WHEN 3 THEN 'cargo' END), lambda x: x IS NOT NULL))), ',') AS managers FROM d GROUP BY 1""")  # fmt: skip
def stack_profile(spark, sf_dir):
    files = _files(spark, sf_dir, f"concat(source, {pick('doc_id', repr('/package.json'), repr('/a.ts'), repr('/b.py'), repr('/Cargo.toml'))})", "''")
    return rules.stack_profile(files).select("root", F.array_join("languages", ",").alias("languages"), F.array_join("managers", ",").alias("managers"))


_TREE = f"concat({pick('doc_id', repr('src/'), repr('node_modules/'), repr('.git/'), repr('lib/'))}, source, {pick('doc_id', repr('.py'), repr('.js'), repr('.rs'), repr(''))})"


@register("repository_walk", "SELECT CASE doc_id % 4 WHEN 0 THEN 'src/' || source || '.py' ELSE 'lib/' || source END AS path, CASE WHEN doc_id % 4 = 0 THEN 'Python' END AS language, CASE WHEN n_chars <= 5242 THEN 'read' ELSE 'oversize' END AS state FROM documents WHERE doc_id % 4 IN (0, 3)")
def repository_walk(spark, sf_dir):
    """Files of a tree: pruned folders are left out, files that are too large are named."""
    return repository.classify_files(table(spark, sf_dir, "documents").select(F.expr(_TREE).alias("path"), F.when(F.col("n_chars") <= 5242, F.col("n_chars")).otherwise(6 << 20).alias("length")))


@register("walk_guard", "SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(*) <= 20000 AND sum(n_chars) <= 268435456 AS within_bounds FROM documents")
def walk_guard(spark, sf_dir):
    return repository.walk_guard(table(spark, sf_dir, "documents").select(F.expr(_TREE).alias("path"), F.col("n_chars").alias("length")))


# ------------------------------------------------------------------ lock files

_PACKAGE = "replace(p_name, ' ', '-')"
_LOCK = [
    ("requirements.txt", "concat('# c\\n', {n}, '==', {v}, ' # x\\nother>=2\\n')", "PyPI", False),
    ("go.mod", "concat('module m\\nrequire (\\n\\tgithub.com/', {n}, ' v', {v}, '\\n)\\n')", "Go", False),
    ("Cargo.lock", "concat('[[package]]\\nname = \"', {n}, '\"\\nversion = \"', {v}, '\"\\n')", "crates.io", False),
    ("package-lock.json", "concat('{{\"packages\": {{\"\": {{\"version\": \"0\"}}, \"node_modules/', {n}, '\": {{\"version\": \"', {v}, '\", \"dev\": true}}}}}}')", "npm", True),
    ("composer.lock", "concat('{{\"packages\": [{{\"name\": \"', {n}, '\", \"version\": \"v', {v}, '\"}}]}}')", "Packagist", False),
    ("yarn.lock", "concat('# v1\\n', {n}, '@^1:\\n  version \"', {v}, '\"\\n')", "npm", False),
]


#: the other formats, with what stands before the name
_MORE_LOCKS = [
    ("pnpm-lock.yaml", "concat('lockfileVersion: 9\\npackages:\\n  ', {n}, '@', {v}, ':\\n    dev: true\\nsnapshots:\\n  c@9.9: {{}}\\n')", "npm", True, ""),
    ("bun.lock", "concat('{{\"packages\": {{\"', {n}, '\": [\"', {n}, '@', {v}, '\", \"\", {{}}, \"sha\"],}}}}')", "npm", False, ""),
    ("Pipfile.lock", "concat('{{\"default\": {{}}, \"develop\": {{\"', {n}, '\": {{\"version\": \"==', {v}, '\"}}, \"git\": {{\"ref\": \"x\"}}}}}}')", "PyPI", True, ""),
    ("gradle.lockfile", "concat('# c\\norg.x:', {n}, ':', {v}, '=testCompileClasspath,testRuntimeClasspath\\nempty=z\\n')", "Maven", True, "org.x:"),
    ("packages.lock.json", "concat('{{\"dependencies\": {{\"net8.0\": {{\"', {n}, '\": {{\"type\": \"Direct\", \"resolved\": \"', {v}, '\"}}, \"P\": {{\"type\": \"Project\"}}}}}}}}')", "NuGet", False, ""),
    ("pom.xml", "concat('<project><properties><v>', {v}, '</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>', {n}, '</artifactId><version>$', '{{v}}</version></dependency></dependencies></project>')", "Maven", False, "g:"),
    ("app.csproj", "concat('<Project><PackageReference Include=\"', {n}, '\" Version=\"', {v}, '\" /><PackageReference Include=\"W\" Version=\"$', '(V)\" /></Project>')", "NuGet", False, ""),
    ("Gemfile.lock", "concat('GEM\\n  specs:\\n    ', {n}, ' (', {v}, ')\\nPLATFORMS\\n  ruby\\n')", "RubyGems", False, ""),
    ("poetry.lock", "concat('[[package]]\\nname = \"', {n}, '\"\\nversion = \"', {v}, '\"\\ncategory = \"dev\"\\n')", "PyPI", True, ""),
]


@register("lock_files_parsed", f"""SELECT p_partkey || '/' || [{", ".join(repr(k[0]) for k in _LOCK)}][p_partkey % 6 + 1] AS manifest_path, [{", ".join(repr(k[2]) for k in _LOCK)}][p_partkey % 6 + 1] AS ecosystem, CASE WHEN p_partkey % 6 = 1 THEN 'github.com/' ELSE '' END || replace(p_name, ' ', '-') AS name, p_size || '.0.' || (p_partkey % 9) AS version, p_partkey % 6 = 3 AS is_dev FROM part
UNION ALL SELECT 'm' || p_partkey || '/' || [{", ".join(repr(k[0]) for k in _MORE_LOCKS)}][p_partkey % 9 + 1], [{", ".join(repr(k[2]) for k in _MORE_LOCKS)}][p_partkey % 9 + 1], [{", ".join(repr(k[4]) for k in _MORE_LOCKS)}][p_partkey % 9 + 1] || replace(p_name, ' ', '-'), p_size || '.0.' || (p_partkey % 9), [{", ".join(str(k[3]).lower() for k in _MORE_LOCKS)}][p_partkey % 9 + 1] FROM part""")  # fmt: skip
def lock_files_parsed(spark, sf_dir):
    """Two manifests for every part: one in one of six formats, one in one of the nine others."""
    version = "concat(p_size, '.0.', p_partkey % 9)"

    def manifests(before, kinds):
        path = f"concat('{before}', p_partkey, '/', " + pick("p_partkey", *[repr(k[0]) for k in kinds]) + ")"
        text = pick("p_partkey", *[k[1].format(n=_PACKAGE, v=version) for k in kinds])
        return table(spark, sf_dir, "part").select(F.expr(path).alias("path"), F.expr(text).alias("text"))

    files = manifests("", _LOCK).unionByName(manifests("m", _MORE_LOCKS))
    return repository.parse_manifests(files).select("manifest_path", "ecosystem", "name", "version", "is_dev")


# ------------------------------------------------------------------ catalogs and integrity


@register("source_integrity", "SELECT doc_id::VARCHAR AS path, CASE doc_id % 5 WHEN 0 THEN 'integrity_failed' WHEN 1 THEN 'not_installed' ELSE 'ready' END AS status FROM documents")
def source_integrity(spark, sf_dir):
    """Documents as installed files against their sizes and digests; some are damaged, some missing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    want = d.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.upper(F.sha2("content", 256)).alias("sha256"))
    stored = d.filter("doc_id % 5 <> 1").select("path", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content")).alias("content"))
    return catalog.integrity(want, stored).select("path", "status")


def _catalogs(spark, sf_dir):
    """A catalog for every language: its sources as datasets, source 1 twice, documents divisible by 50 as files outside, a route to a source that is not there."""
    d = table(spark, sf_dir, "documents")
    file = F.struct(F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("../"), F.col("doc_id").cast("string"))).otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("path"), F.col("n_chars").alias("size_bytes"), F.lit("00").alias("sha256"))
    sets = d.groupBy("lang", "source").agg(F.collect_list(file).alias("files")).withColumn("id", F.concat_ws("/", "lang", "source"))
    sets = sets.unionByName(sets.filter("source = 'src1'"))
    whole = sets.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("id", "files"))).alias("datasets"))
    route = F.map_from_arrays(F.array(F.lit("train")), F.array(F.concat(F.transform("datasets", lambda s: s["id"]), F.array(F.concat("lang", F.lit("/zz"))))))
    return whole.select(F.when(F.col("lang") == "en", 2).otherwise(1).alias("schema_version"), "datasets", route.alias("routes"))


@register("catalog_violations", """SELECT 'unsafe_path' AS rule, '../' || doc_id AS subject FROM documents WHERE doc_id % 50 = 0 AND source <> 'src1' UNION ALL SELECT 'unsafe_path', unnest(['../' || doc_id, '../' || doc_id]) FROM documents WHERE doc_id % 50 = 0 AND source = 'src1'
UNION ALL SELECT DISTINCT 'duplicate_id', lang || '/src1' FROM documents WHERE source = 'src1' UNION ALL SELECT DISTINCT 'unknown_route', lang || '/zz' FROM documents UNION ALL SELECT DISTINCT 'schema_version', '2' FROM documents WHERE lang = 'en'""")  # fmt: skip
def catalog_violations(spark, sf_dir):
    return catalog.catalog_violations(_catalogs(spark, sf_dir))


@register("catalog_route", """WITH s AS (SELECT DISTINCT lang, lang || '/' || source AS dataset, source FROM documents), t AS (SELECT lang, dataset FROM s UNION ALL SELECT lang, dataset FROM s WHERE source = 'src1' UNION ALL SELECT DISTINCT lang, lang || '/zz' FROM documents)
SELECT row_number() OVER (PARTITION BY lang ORDER BY dataset) - 1 AS place, dataset FROM t""")  # fmt: skip
def catalog_route(spark, sf_dir):
    return catalog.route(_catalogs(spark, sf_dir), "train")


@register("advisory_directory", "SELECT DISTINCT 'ADV-' || l_orderkey AS id, false AS complete FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 5")
def advisory_directory(spark, sf_dir):
    """Records of a directory of JSON files that concern wanted packages (parts of small sizes); a broken file makes the source incomplete."""
    from quarrylight.operators.advisories import read_advisories
    from quarrylight.plans.text import _advisory_texts, _inventory
    from quarrylight.session import scratch

    path = scratch(spark, "osv")
    records = _advisory_texts(spark, sf_dir).unionByName(spark.range(1).select(F.lit("{broken").alias("value")))
    records.write.option("compression", "lz4").option("maxRecordsPerFile", 16384).text(path)  # small files, since a compressed one is read by one task
    wanted = _inventory(spark, sf_dir).join(table(spark, sf_dir, "part").filter("p_size < 5").select("p_partkey"), "p_partkey").select("ecosystem", "name").distinct()
    return read_advisories(spark, path, wanted).select("id", "complete")


# ------------------------------------------------------------------ models, searches, plans, bindings

_MODELS = "SELECT p_name AS id, p_partkey AS version, unnest(CASE WHEN p_size % 2 = 0 THEN ['scan', 'rank'] ELSE ['scan'] END) AS action FROM part WHERE p_size % 3 = 0"


@register("models_routed", f"WITH m AS ({_MODELS}) SELECT action, id, version, row_number() OVER (PARTITION BY action ORDER BY id, version) AS place FROM m QUALIFY place <= 25")
def models_routed(spark, sf_dir):
    """Ready models of every action, by id and version."""
    actions = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("scan"), F.lit("rank"))).otherwise(F.array(F.lit("scan")))
    m = table(spark, sf_dir, "part").filter("p_size % 3 = 0").select(F.explode(actions).alias("action"), F.col("p_name").alias("id"), F.col("p_partkey").alias("version"))
    return R.top_per_key(m, ["action"], [F.col("id"), F.col("version")], 25, "place").select("action", "id", "version", "place")


@register("models_status", "SELECT p_brand AS vendor, bool_or(p_size % 3 = 0) AS any_ready, count(*) AS installed, count(*) FILTER (p_size % 3 = 0) AS ready FROM part GROUP BY 1")
def models_status(spark, sf_dir):
    ready = F.col("p_size") % 3 == 0
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("vendor")).agg(F.bool_or(ready).alias("any_ready"), F.count(F.lit(1)).alias("installed"), F.count_if(ready).alias("ready"))


@register("memory_search_literal", "SELECT doc_id AS id FROM documents WHERE doc_id % 4 IN (0, 2)")
def memory_search_literal(spark, sf_dir):
    """% and _ of the text sought stand for themselves, in either column and any case."""
    a, b = pick("doc_id", "concat(lang, ' 100%_x')", "concat(lang, ' 100 x')", "NULL", "NULL"), pick("doc_id", "NULL", "source", "concat('A 100%_X ', source)", "NULL")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(a).alias("a"), F.expr(b).alias("b")).filter(I.any_like("100%_x", "a", "b")).select("id")


@register("plan_violations", """WITH t AS (SELECT o_orderkey AS plan_id, o_orderkey % 6 AS k FROM orders)
SELECT plan_id, unnest(CASE k WHEN 1 THEN ['mandatory', 'size'] WHEN 2 THEN ['second_dependency', 'dependency'] WHEN 3 THEN ['unknown_role', 'role_order'] WHEN 4 THEN ['objective', 'later_dependency'] WHEN 5 THEN ['first_has_dependency', 'dependency_order', 'dependency_order'] ELSE [] END) AS rule,
unnest(CASE k WHEN 1 THEN ['source', NULL] WHEN 2 THEN ['source', 'source'] WHEN 3 THEN ['magic', 'magic'] WHEN 4 THEN ['source', 'database'] WHEN 5 THEN ['scout', 'scout', 'x'] ELSE [] END) AS role FROM t WHERE k <> 5 AND k <> 2
UNION ALL SELECT plan_id, unnest(['first_has_dependency', 'dependency_order']), 'scout' FROM t WHERE k = 5 UNION ALL SELECT plan_id, unnest(['second_dependency', 'dependency']), 'source' FROM t WHERE k = 2""")  # fmt: skip
def plan_violations(spark, sf_dir):
    """A plan for every order; five of six break rules."""
    step = "named_struct('position', {}, 'role', {}, 'objective', {}, 'depends_on', {})"
    none, first, second = "cast(array() as array<string>)", "array('scout')", "array('source')"
    plans = [
        [("scout", "'look'", none), ("source", "'read'", first), ("database", "'check'", second)],
        [("scout", "'look'", none)],
        [("scout", "'look'", none), ("source", "'read'", "array('gone')"), ("database", "'check'", second)],
        [("scout", "'look'", none), ("source", "'read'", first), ("magic", "'do'", second)],
        [("scout", "'look'", none), ("source", "'  '", first), ("database", "'check'", first)],
        [("scout", "'look'", second), ("source", "'read'", first)],
    ]
    rows = pick("o_orderkey", *["array(" + ", ".join(step.format(i, repr(r), o, d) for i, (r, o, d) in enumerate(p)) + ")" for p in plans])
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.explode(F.expr(rows)).alias("s")).select("plan_id", "s.*")
    return I.plan_violations(tasks)


@register("parameter_overlap", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN array_to_string(list_sort(['id', split_part(p_name, ' ', 1)]), ',') ELSE split_part(p_name, ' ', 1) END AS result FROM part")
def parameter_overlap(spark, sf_dir):
    a = F.array(F.lit("Id"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("q"))
    b = F.array(F.when(F.col("p_size") % 2 == 0, "ID").otherwise("x"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("z"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(J.parameter_overlap(a, b)), ",").alias("result"))


_IMPORT = pick("doc_id", "concat('./', doc_id % 40)", "'react'", "concat('../lib/', doc_id % 40)", "'../../../x'", "concat('./m', doc_id % 40)")


@register("imports_resolved", """WITH n AS (SELECT doc_id AS id, doc_id % 40 AS k, doc_id % 5 AS t FROM documents)
SELECT id, CASE WHEN t = 0 AND k % 2 = 0 THEN 'src/' || k || '.tsx' WHEN t = 2 AND k % 3 = 0 THEN 'lib/' || k || '/index.ts' END AS target, CASE WHEN t = 1 THEN 'external' WHEN (t = 0 AND k % 2 = 0) OR (t = 2 AND k % 3 = 0) THEN 'resolved_local' ELSE 'unresolved' END AS state FROM n""")  # fmt: skip
def imports_resolved(spark, sf_dir):
    """An import for every document, tried against the files that the documents make."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), J.import_candidates(F.lit("src/a.ts"), F.lit("TypeScript"), F.expr(_IMPORT)).alias("c"))
    k = F.col("doc_id") % 40
    files = d.select(F.explode(F.array_compact(F.array(F.when(k % 2 == 0, F.concat(F.lit("src/"), k.cast("string"), F.lit(".tsx"))), F.when(k % 3 == 0, F.concat(F.lit("lib/"), k.cast("string"), F.lit("/index.ts")))))).alias("target")).distinct()
    hit = J.first_match(rows, files, "id", "c", "target")
    state = F.when(F.col("c").isNull(), "external").when(F.col("target").isNotNull(), "resolved_local").otherwise("unresolved")
    return rows.select("id", "c").join(hit.select("id", "target"), "id").select("id", "target", state.alias("state"))


@register("bindings_resolved", """SELECT p_partkey AS route_id, CASE p_partkey % 5 WHEN 0 THEN p_partkey * 10 WHEN 1 THEN p_partkey * 10 WHEN 4 THEN NULL END AS handler_id, ['resolved', 'resolved', 'ambiguous', 'unresolved', 'unbound'][p_partkey % 5 + 1] AS state FROM part""")
def bindings_resolved(spark, sf_dir):
    """A route for every part, bound by name, by default, by * to a file of two, to a name that is not there, or not at all; later bindings of a name don't count."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("u"))
    file = F.concat(F.lit("r"), F.col("k").cast("string"))
    routes = p.select(F.col("k").alias("route_id"), file.alias("file"), F.lit("h").alias("handler"))
    imported = F.element_at(F.array(F.lit("list"), F.lit("default"), F.lit("*"), F.lit("gone")), (F.col("k") % 5 + 1).cast("int"))
    bound = p.filter("k % 5 < 4").withColumn("imported", imported)
    bindings = bound.select(file.alias("file"), F.lit(0).alias("ordinal"), F.lit("h").alias("local"), "imported", F.col("u").alias("target_file"))
    bindings = bindings.unionByName(bound.select(file.alias("file"), F.lit(1).alias("ordinal"), F.lit("h").alias("local"), F.lit("other").alias("imported"), F.col("u").alias("target_file")))
    handlers = p.select(F.col("u").alias("file"), F.lit("list").alias("name"), (F.col("k") * 10).alias("handler_id"))
    handlers = handlers.unionByName(p.filter("k % 5 <> 1").select(F.col("u").alias("file"), F.lit("add").alias("name"), (F.col("k") * 10 + 1).alias("handler_id")))
    return J.resolve_bindings(routes, bindings, handlers)


# ------------------------------------------------------------------ recorded responses and API descriptions


@register("openapi_operations", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o FROM pages WHERE page_id % 3 <> 2)
SELECT CASE WHEN page_id % 3 = 0 THEN 'https://api.x/v' || page_id ELSE o END || '/users/{id}' AS url, unnest(['GET', 'DELETE']) AS method, unnest(['path:id,query:q' || page_id, '']) AS parameters FROM p""")  # fmt: skip
def openapi_operations(spark, sf_dir):
    """An API description for every page; a third names a server, a third is no JSON."""
    body = "concat('{', CASE WHEN page_id % 3 = 0 THEN concat('\"servers\": [{\"url\": \"https://api.x/v', page_id, '/\"}], ') WHEN page_id % 3 = 2 THEN 'no json ' ELSE '' END, '\"paths\": {\"/users/{id}\": {\"get\": {\"parameters\": [{\"name\": \"q', page_id, '\", \"in\": \"query\"}, {\"name\": \"id\", \"in\": \"path\"}]}, \"delete\": {}, \"summary\": \"s\"}}}')"
    d = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1).alias("base"), F.expr(body).alias("body"))
    return H.openapi_operations(d).select("url", "method", F.array_join("parameters", ",").alias("parameters"))


@register("response_findings", r"""WITH p AS (SELECT page_id, url LIKE 'https%' AS s, page_id % 2 = 0 AS page, page_id % 3 = 0 AS cookie, page_id % 5 = 0 AS server, page_id % 7 = 0 AS cors, page_id % 11 = 0 AS err FROM pages)
SELECT page_id, array_to_string(list_sort(list_filter([CASE WHEN s THEN 'missing_hsts' END, CASE WHEN page THEN 'missing_csp' END, CASE WHEN page THEN 'missing_frame_protection' END, CASE WHEN page THEN 'missing_referrer_policy' END, CASE WHEN server THEN 'server_version' END, CASE WHEN cors THEN 'cors_any_origin_with_credentials' END, CASE WHEN err THEN 'verbose_error' END,
CASE WHEN cookie THEN 'cacheable_with_cookie' END, CASE WHEN cookie THEN 'cookie_without_samesite' END, CASE WHEN cookie AND s THEN 'cookie_without_secure' END, CASE WHEN page AND s AND page_id % 13 = 0 THEN 'mixed_content' END], lambda x: x IS NOT NULL)), ',') AS result FROM p""")  # fmt: skip
def response_findings(spark, sf_dir):
    """A recorded response for every page, made of its id and scheme."""
    id_ = F.col("page_id")
    headers = {"content-type": F.when(id_ % 2 == 0, "text/html").otherwise("text/plain"), "x-content-type-options": F.lit("nosniff"), "server": F.when(id_ % 5 == 0, "x/1.2").otherwise("x"), "access-control-allow-origin": F.when(id_ % 7 == 0, "*").otherwise("null"), "access-control-allow-credentials": F.lit("true")}
    head = F.map_from_arrays(F.array(*map(F.lit, headers)), F.array(*headers.values()))
    cookies = F.when(id_ % 3 == 0, F.array(F.lit("sid=1; HttpOnly"))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.when(id_ % 11 == 0, "Traceback (most recent").otherwise("fine"), F.when(id_ % 13 == 0, " http://m").otherwise(""))
    found = H.response_findings(F.when(id_ % 11 == 0, 500).otherwise(200), head, cookies, body, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(found), ",").alias("result"))
