"""Line and statement rules over source text: SQL scripts, Prisma, Dockerfile and Compose, Python lines, taint flow.

State that runs down a file is a running window over its lines. Statement splitting and taint tracking are character and
line state machines; they run inside Arrow batches or grouped by file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.scalar import image_is_mutable
from quarrylight.session import workers_find_us
from quarrylight.sources.repository import language_of, lines_of

# ------------------------------------------------------------------ SQL scripts


def split_statements(text: str) -> list[tuple[int, str]]:
    """(first line, statement) with literals emptied and comments dropped."""
    out, buf, line, start, i = [], [], 1, None, 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if two == "--":
            stop = text.find("\n", i)
            i = len(text) if stop < 0 else stop
        elif two == "/*":
            stop = text.find("*/", i + 2)
            stop = len(text) if stop < 0 else stop + 2
            line += text.count("\n", i, stop)
            i = stop
            buf.append(" ")
        elif c in "'\"`":
            stop = i + 1
            while stop < len(text) and not (text[stop] == c and text[stop + 1 : stop + 2] != c):
                stop += 2 if text[stop] == c else 1
            start = line if start is None else start
            line += text.count("\n", i, stop)
            buf.append("''" if c == "'" else text[i : stop + 1])
            i = stop + 1
        elif c == ";":
            if start is not None:
                out.append((start, "".join(buf).strip()))
            buf, start, i = [], None, i + 1
        else:
            if not c.isspace() and start is None:
                start = line
            line += c == "\n"
            buf.append(c)
            i += 1
    if start is not None:
        out.append((start, "".join(buf).strip()))
    return out


def sql_statements(files: DataFrame) -> DataFrame:
    """files(path, text): path, line (where it starts), statement, with literals emptied and comments dropped."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, s) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, s in split_statements(t or "")]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "line", "statement"])

    workers_find_us(files.sparkSession)
    return files.select("path", "text").mapInArrow(split, "path string, line long, statement string")


def sql_findings(files: DataFrame) -> DataFrame:
    """files(path, text): rule, severity, confidence, line of destructive statements. Texts without any of their words aren't split."""
    files = files.filter(F.col("text").rlike(r"(?i)\b(DROP|TRUNCATE|ALTER|UPDATE|DELETE|PRAGMA)\b"))
    s = F.upper(F.regexp_replace("statement", r"\s+", " "))
    rules = [
        ("sql.destructive_ddl", "medium", 0.98, s.rlike(r"^(DROP (TABLE|DATABASE|SCHEMA|VIEW|INDEX|COLUMN)|TRUNCATE)\b") | s.rlike(r"^ALTER TABLE .* DROP ")),
        ("sql.unbounded_write", "high", 0.96, s.rlike(r"^(UPDATE|DELETE FROM)\b") & ~s.rlike(r"\bWHERE\b")),
        ("sql.foreign_keys_off", "high", 0.99, s.rlike(r"^PRAGMA FOREIGN_KEYS ?= ?(OFF|0|FALSE|NO)")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("severity"), F.lit(p).alias("confidence"))) for r, v, p, c in rules]))
    return sql_statements(files).select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.*")


def prisma_findings(files: DataFrame) -> DataFrame:
    """Literal connection URLs inside datasource blocks; braces are summed down the file."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    code = F.regexp_replace("source", "//.*$", "")
    head = F.when(code.rlike(r"^\s*datasource\s"), True).when(code.rlike(r"^\s*(model|generator|enum|type|view)\s"), False)
    lines = lines_of(files).withColumn("_in", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(False)))
    depth = F.sum(F.regexp_count(code, F.lit(r"\{")) - F.regexp_count(code, F.lit(r"\}"))).over(w)
    hit = F.col("_in") & (F.col("_d") > 0) & F.col("source").rlike(r'^\s*(url|directUrl)\s*=\s*"')
    return lines.withColumn("_d", depth).filter(hit).select("path", "line", F.lit("prisma.literal_url").alias("rule"))


def dockerfile_findings(files: DataFrame) -> DataFrame:
    image = F.regexp_extract("source", r"(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)", 1)
    mutable = (image != "") & (F.lower(image) != "scratch") & image_is_mutable(image)
    off = F.col("source").rlike(r"(?i)^\s*HEALTHCHECK\s+NONE\b")
    lines = lines_of(files).select("path", "line", F.when(mutable, "docker.mutable_image").when(off, "docker.healthcheck_disabled").alias("rule")).filter("rule IS NOT NULL")
    none = files.filter(~F.col("text").rlike(r"(?im)^\s*HEALTHCHECK\b") & F.col("text").rlike(r"(?im)^\s*FROM\b")).select("path", F.lit(1).cast("int").alias("line"), F.lit("docker.no_healthcheck").alias("rule"))
    return lines.unionByName(none)


def compose_findings(files: DataFrame) -> DataFrame:
    """Per service: mutable image, no or disabled healthcheck, restart "no"; services are the headers that propagate down."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    code = F.regexp_replace("source", r"\s+#.*$|^\s*#.*$", "")
    lines = lines_of(files).withColumn("_c", code).filter(F.trim("_c") != "")
    lines = lines.withColumn("_top", F.last(F.when(F.col("_c").rlike(r"^\S"), F.col("_c")), ignorenulls=True).over(w))
    lines = lines.withColumn("service", F.last(F.when(F.col("_c").rlike(r"^  [^\s#-][^:]*:\s*$"), F.regexp_extract("_c", r"^  ([^:]+):", 1)), ignorenulls=True).over(w)).filter("_top LIKE 'services:%' AND service IS NOT NULL")
    value = lambda k: F.max(F.when(F.col("_c").rlike(rf"^    {k}\s*:"), F.regexp_replace(F.regexp_extract("_c", rf"^    {k}\s*:\s*(.*?)\s*$", 1), "^[\"']|[\"']$", "")))
    s = lines.groupBy("path", "service").agg(F.min("line").alias("line"), value("image").alias("image"), value("restart").alias("restart"), value("healthcheck").alias("health"), F.max(F.col("_c").rlike(r"^      (disable:\s*true|test:\s*\[?\s*[\"']?NONE)")).alias("off"))
    rules = [F.when(image_is_mutable(F.col("image")) & (F.col("image") != ""), "compose.mutable_image"), F.when(F.col("restart") == "no", "compose.no_restart"), F.when(F.col("off"), "compose.healthcheck_disabled").when(F.col("health").isNull(), "compose.no_healthcheck")]
    return s.select("path", "service", "line", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


# ------------------------------------------------------------------ line rules and taint

#: fixed values: what reads a request, what takes SQL, and the rules (name, category, severity, confidence, CWE, suffixes or all, pattern), patterns in any case
REQUEST = r"(?:request\.(?:args|form|json|values|GET|POST|query_params|path_params)|req\.(?:query|body|params)|ctx\.request|\$_(?:GET|POST|REQUEST)|params\[|request\[)"
SQL_CALL = r"(?:execute|executemany|query|raw|\$queryRawUnsafe|\$executeRawUnsafe|mysqli_query|->query)"
HEADER_CALL = r"(?:res\.(?:setHeader|header|set)\s*\(|header\s*\(|response\.headers\[[^\]]+\]\s*=)"
_JS, _CODE = (".js", ".jsx", ".ts", ".tsx"), (".py", ".js", ".jsx", ".ts", ".tsx", ".php")
LINE_RULES = [
    ("web.sql.dynamic_query", "database", "high", 0.96, "CWE-89", (".py", *_JS), r"""(?:execute|executemany|query|raw)\s*\(\s*(?:f["']|[^\n;]*(?:\+|\.format\(|%\s*\())"""),
    ("web.sql.request_to_query", "database", "high", 0.99, "CWE-89", _CODE, SQL_CALL + r"\s*\([^\n;]*" + REQUEST),
    ("web.xss.request_to_html", "xss", "high", 0.95, "CWE-79", (*_JS, ".php"), r"(?:dangerouslySetInnerHTML|\.innerHTML\s*=|document\.write\s*\(|echo\s+|print\s+)[^\n;]*" + REQUEST),
    ("web.ssrf.request_url", "ssrf", "high", 0.94, "CWE-918", (".py", *_JS), r"(?:requests\.(?:get|post|put|delete)|httpx\.(?:get|post|put|delete)|urllib\.request\.urlopen|fetch\s*\(|axios\.(?:get|post|put|delete))[^\n;]*" + REQUEST),
    ("web.command.request_to_process", "command_injection", "critical", 0.97, "CWE-78", (".py", *_JS), r"(?:os\.system|subprocess\.(?:run|Popen|call|check_output)|child_process\.(?:exec|execSync)|\bexecSync\s*\()[^\n;]*" + REQUEST),
    ("web.path.request_to_file", "path_traversal", "high", 0.91, "CWE-22", (".py", *_JS), r"(?:open\s*\(|send_file\s*\(|FileResponse\s*\(|fs\.(?:readFile|readFileSync)\s*\()[^\n;]*" + REQUEST),
    ("web.deserialize.untrusted", "unsafe_deserialization", "high", 0.95, "CWE-502", (".py", ".php"), r"(?:pickle\.(?:loads|load)|yaml\.load\s*\(|unserialize\s*\()[^\n;]*" + REQUEST),
    ("web.cors.wildcard", "cors", "medium", 0.98, "CWE-942", None, r"""(?:allow_origins\s*=\s*\[\s*["']\*["']|Access-Control-Allow-Origin[^\n]*\*|origin\s*:\s*["']\*["'])"""),
    ("web.csrf.disabled", "csrf", "medium", 0.96, "CWE-352", None, r"(?:@csrf_exempt|WTF_CSRF_ENABLED\s*=\s*False|verify_csrf_token\s*=\s*False|csrf\s*:\s*false)"),
    ("web.session.insecure_cookie", "session", "medium", 0.98, "CWE-614", None, r"(?:SESSION_COOKIE_SECURE\s*=\s*False|SESSION_COOKIE_HTTPONLY\s*=\s*False|secure\s*:\s*false[^\n]*cookie)"),
    ("web.jwt.verification_disabled", "authentication", "critical", 0.99, "CWE-347", None, r"""(?:verify_signature["']?\s*[:=]\s*False|jwt\.decode\([^\n]*verify\s*=\s*False|algorithms?\s*=\s*\[["']none["']\])"""),
    ("web.debug.enabled", "debug_exposure", "medium", 0.96, "CWE-489", (".py",), r"(?:app\.run\([^\n]*debug\s*=\s*True|\bDEBUG\s*=\s*True\b)"),
    ("web.sql.orm_unsafe_raw", "database", "critical", 0.99, "CWE-89", _JS, r"(?:\$queryRawUnsafe|\$executeRawUnsafe|sequelize\.literal|knex\.raw|db\.raw)\s*\([^\n;]*" + REQUEST),
    ("web.sql.dynamic_identifier", "database", "high", 0.96, "CWE-89", _CODE, SQL_CALL + r"\s*\([^\n;]*(?:FROM|JOIN|ORDER\s+BY|GROUP\s+BY|UPDATE|INTO)\s+[^\n;]*" + REQUEST),
    ("web.sql.multistatement_enabled", "database", "high", 0.98, "CWE-89", (".py", *_JS), r"(?:multipleStatements|allowMultiQueries|multiStatements)\s*[:=]\s*true"),
    ("database.sql.dynamic_exec", "database", "high", 0.91, "CWE-89", (".sql",), r"\b(?:EXEC(?:UTE)?(?:\s+IMMEDIATE)?|PREPARE)\b[^\n;]*(?:\+|\|\||CONCAT\s*\()"),
    ("database.sql.dynamic_prepare", "database", "medium", 0.84, "CWE-89", (".sql",), r"\bPREPARE\s+[A-Za-z_][A-Za-z0-9_]*\s+FROM\s+[@:$]?[A-Za-z_][A-Za-z0-9_]*"),
    ("web.database.connection_tls_disabled", "database", "high", 0.96, "CWE-319", None, r"(?:DATABASE_URL|DB_URL|connectionString|connection_string)[^\n;]*(?:sslmode\s*=\s*disable|ssl\s*=\s*false|ssl=false)"),
    ("web.header.request_to_response", "header_injection", "high", 0.93, "CWE-113", _CODE, HEADER_CALL + r"[^\n;]*" + REQUEST),
]
#: fixed values: rules of request input that reaches a call through variables, in the form of LINE_RULES
TAINT_RULES = [
    ("web.sql.tainted_variable_to_query", "database", "critical", 0.94, "CWE-89"),
    ("web.header.tainted_value", "header_injection", "high", 0.89, "CWE-113"),
]
COMMENTS = {".py": r"^\s*#", **dict.fromkeys((*_JS, ".php"), r"^\s*(//|\*)"), ".sql": r"^\s*--"}
EXCERPT, TAINT_LINES = 240, 40


def _suffix() -> Column:
    return F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))


def rule_excerpt(line: Column) -> Column:
    """A line as evidence: named secrets and passwords in addresses are withheld, at most EXCERPT characters."""
    t = F.regexp_replace(F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")), r"""(?i)((?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*)["'][^"']*["']""", '$1"<redacted>"')
    t = F.regexp_replace(t, r"(?i)((?:postgres(?:ql)?|mysql|mariadb|https?)://[^:/\s]+:)[^@\s]+@", "$1<redacted>@")
    return F.when(F.length(t) > EXCERPT, F.concat(F.substring(t, 1, EXCERPT - 3), F.lit("..."))).otherwise(t)


def _as_findings(hits: DataFrame, rules: list, extra: Column) -> DataFrame:
    """hits(path, line, source, k) as findings of rules[k], each (rule, path, line, excerpt) once."""
    facts = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("rule", "category", "severity", "confidence", "cwe"), r[:5], strict=True)]) for r in rules])
    rows = hits.withColumns({"_f": F.element_at(facts, F.col("k") + 1), "excerpt": rule_excerpt(F.col("source")), "_x": extra})
    parts = [F.encode(c.cast("string"), "UTF-8") for c in (F.col("_f.rule"), F.col("path"), F.col("line"), F.col("excerpt"), F.col("_x"))]
    whole = reduce(lambda a, b: F.concat(a, F.unhex(F.lit("00")), b), parts)
    keep = [c for c in hits.columns if c not in ("path", "line", "source", "k")]
    return rows.select("path", F.col("line").cast("long").alias("line"), "_f.*", "excerpt", F.sha2(whole, 256).alias("fingerprint"), *keep)


def line_findings(files: DataFrame) -> DataFrame:
    """files(path, text): path, line, rule, category, severity, confidence, cwe, excerpt, fingerprint of every rule on every line.

    A rule looks at files of its suffixes; comment lines are left out. A line meets one regular expression after the other in one
    projection, and only its hits become rows. Null texts have no lines.
    """
    suffix = _suffix()
    comment = reduce(lambda w, kv: w.when(suffix == kv[0], F.col("source").rlike(kv[1])), COMMENTS.items(), F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    applies = lambda s: F.lit(True) if s is None else suffix.isin(*s)
    hits = F.array_compact(F.array(*[F.when(applies(r[5]) & F.col("source").rlike("(?i)" + r[6]), F.lit(k)) for k, r in enumerate(LINE_RULES)]))
    found = lines_of(files).filter(~comment).select("path", "line", "source", F.explode(hits).alias("k"))
    return _as_findings(found, LINE_RULES, F.lit(""))


_ASSIGN = re.compile(r"^\s*(?:(?:const|let|var)\s+)?(\$?[A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.+)$", re.I)
_REQUEST, _SQL_SINK, _HEADER_SINK = (re.compile(p, re.I) for p in (REQUEST, SQL_CALL + r"\s*\(", HEADER_CALL))
#: fixed values: how a variable (V) is put into a text, handed to a query as a whole, or to a header
_BUILT = r"\{\s*V\s*\}|[+.]\s*V\b|\bV\s*[+.]|\.format\s*\([^)]*\bV\b"
_WHOLE_QUERY = r"(?i:" + SQL_CALL + r")\s*\(\s*V\s*[,)]|(?i:mysqli_query)\s*\([^,]+,\s*V\s*[,)]"
_ARGUMENT = r"[(,]\s*V\s*[,)]|=\s*V\s*$"
_MENTION = r"(?<![A-Za-z0-9_$])V(?![A-Za-z0-9_])"


def _about(pattern: str, variable: str, text: str) -> bool:
    return re.search(pattern.replace("V", re.escape(variable)), text) is not None


def taint_of_lines(lines: list[str], comment: str | None = None) -> list[tuple[int, int, str, int]]:
    """(line, rule of TAINT_RULES, variable, line of its source) where request input reaches a call within TAINT_LINES lines.

    Each line in order, comments left out: expire, then assign (set, inherit the source's line, or clear), then look for calls.
    """
    tainted: dict[str, int] = {}
    out = []
    for n, text in enumerate(lines, 1):
        if comment and re.match(comment, text):
            continue
        tainted = {v: at for v, at in tainted.items() if n - at <= TAINT_LINES}
        m = _ASSIGN.match(text)
        if m:
            name, value = m.groups()
            origin = [at for v, at in tainted.items() if v != name and (value.strip().rstrip(";") == v or _about(_BUILT, v, value))]
            if _REQUEST.search(value):
                tainted[name] = n
            elif origin:
                tainted[name] = origin[0]
            else:
                tainted.pop(name, None)
        if not tainted:
            continue
        sql, header = _SQL_SINK.search(text), _HEADER_SINK.search(text)
        for v, at in tainted.items() if sql or header else ():
            if at != n and _about(_MENTION, v, text):
                if sql and (_about(_BUILT, v, text) or _about(_WHOLE_QUERY, v, text)):
                    out.append((n, 0, v, at))
                if header and _about(_ARGUMENT, v, text):
                    out.append((n, 1, v, at))
    return out


def taint_findings(files: DataFrame) -> DataFrame:
    """files(path, text): findings in the form of line_findings, with variable and source_line. A file is one row: nothing is shuffled."""
    workers_find_us(files.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
        for b in batches:
            rows = []
            for path, suffix, text in zip(*(b.column(c).to_pylist() for c in ("path", "suffix", "text")), strict=True):
                lines = text.replace("\r\n", "\n").split("\n")
                rows += [(path, n, lines[n - 1], k, v, at) for n, k, v, at in taint_of_lines(lines, COMMENTS.get(suffix))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "line", "source", "k", "variable", "source_line"])

    # without a source nothing is tainted
    hinted = files.select("path", _suffix().alias("suffix"), "text").filter(F.col("suffix").isin(*_CODE) & F.col("text").rlike("(?i)" + REQUEST))
    hits = hinted.mapInArrow(scan, "path string, line long, source string, k int, variable string, source_line long")
    return _as_findings(hits, TAINT_RULES, F.concat_ws(":", "variable", F.col("source_line").cast("string")))


# ------------------------------------------------------------------ symbols, imports, routes, test frameworks

_SYMBOLS = {
    "Python": r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", "JavaScript": r"(?m)^([ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(function|class)[ \t]+([A-Za-z_$][\w$]*)",
    "TypeScript": r"(?m)^([ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?:async[ \t]+)?(function|class|interface|type)[ \t]+([A-Za-z_$][\w$]*)",
    "Rust": r"(?m)^([ \t]*)(?:pub(?:\([^)]*\))?[ \t]+)?(fn|struct|enum|trait)[ \t]+([A-Za-z_]\w*)", "Go": r"(?m)^()(func|type)[ \t]+(?:\([^)]*\)[ \t]*)?([A-Za-z_]\w*)",
}
_IMPORTS = {
    "Python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "JavaScript": r"""(?m)(?:import|export)\s[^'"\n]*?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]""",
    "TypeScript": r"""(?m)(?:import|export)\s[^'"\n]*?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]""", "Rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)()", "Go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"()',
}
_ROUTES = r"""(?m)^\s*@?\w+\.(get|post|put|patch|delete|route)\(\s*['"]([^'"]+)['"]"""
FRAMEWORKS = {"pytest": r"import pytest|@pytest\.", "unittest": r"import unittest", "jest": r"from ['\"]@jest/globals|jest\.(fn|mock)", "vitest": r"from ['\"]vitest", "playwright": r"@playwright/test", "cypress": r"\bcy\.(visit|get)\(", "junit": r"org\.junit", "go_test": r"testing\.T\b", "rust_test": r"#\[(tokio::)?test\]"}


def _by_language(files: DataFrame, patterns: dict[str, str], groups: int) -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b),
        [files.filter(F.col("language") == lang).select("path", *[F.regexp_extract_all("text", F.lit(p), g + 1).alias(f"g{g}") for g in range(groups)]) for lang, p in patterns.items()],
    )


def symbols(files: DataFrame) -> DataFrame:
    """files(path, language, text): path, kind, name, indent in order of occurrence (pattern-based, not a parser)."""
    rows = _by_language(files, _SYMBOLS, 3).select("path", F.posexplode(F.arrays_zip("g0", "g1", "g2")).alias("ordinal", "s"))
    return rows.select("path", "ordinal", F.col("s.g1").alias("kind"), F.col("s.g2").alias("name"), F.length("s.g0").alias("indent"))


def imports(files: DataFrame) -> DataFrame:
    rows = _by_language(files, _IMPORTS, 2).select("path", F.posexplode(F.arrays_zip("g0", "g1")).alias("ordinal", "s"))
    return rows.select("path", "ordinal", F.coalesce(F.nullif(F.col("s.g0"), F.lit("")), F.col("s.g1")).alias("specifier"))


def routes(files: DataFrame) -> DataFrame:
    """Decorator and call style routes: path, method, template."""
    rows = files.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(_ROUTES), 1).alias("m"), F.regexp_extract_all("text", F.lit(_ROUTES), 2).alias("t"))).alias("r"))
    return rows.select("path", F.when(F.col("r.m") == "route", "GET").otherwise(F.upper("r.m")).alias("method"), F.col("r.t").alias("template"))


def test_frameworks(files: DataFrame) -> DataFrame:
    """files(path, text): test frameworks a file shows, by its text; test files that show none count as <language>_unknown."""
    named = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in FRAMEWORKS.items()]))
    file = F.element_at(F.split("path", "/"), -1)
    unknown = F.when(file.rlike(r"^test_.*\.py$|_test\.py$"), "python_unknown").when(file.rlike(r"\.(test|spec)\.[jt]sx?$"), "javascript_unknown").when(file.rlike("Tests?[.]java$"), "java_unknown")
    hits = F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(unknown)))
    config = F.col("path").rlike(r"(?i)(pytest\.ini|jest\.config|vitest\.config|playwright\.config|cypress\.config)")
    return files.select("path", F.explode(hits).alias("framework"), F.when(config, "config").otherwise("test").alias("evidence"))


#: fixed values: manifests of package managers
MANAGERS = {"package.json": "npm", "Cargo.toml": "cargo", "pyproject.toml": "pip", "requirements.txt": "pip", "go.mod": "go", "composer.json": "composer", "Gemfile": "bundler", "pom.xml": "maven", "build.gradle": "gradle"}


def stack_profile(files: DataFrame) -> DataFrame:
    """files(path): per top folder its languages and package managers, each once and sorted."""
    name = F.element_at(F.split("path", "/"), -1)
    manager = reduce(lambda w, kv: w.when(name == kv[0], F.lit(kv[1])), MANAGERS.items(), F.when(F.lit(False), F.lit("")))
    language = F.nullif(language_of(F.col("path")), F.lit(""))
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).agg(F.array_sort(F.collect_set(language)).alias("languages"), F.array_sort(F.collect_set(manager)).alias("managers"))


def references(files: DataFrame) -> DataFrame:
    """files(path, text) of JavaScript and TypeScript: direct calls and constructors by name, methods and keywords left out."""
    code = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", " "), r"""\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'""", "''")
    pattern = F.lit(r"(?<![.\w$])(new\s+)?(?!(?:if|for|while|switch|catch|function|return|typeof|await|super|import)\b)([A-Za-z_$][\w$]*)\s*\(")
    rows = files.filter(F.col("path").rlike(r"\.[jt]sx?$")).select("path", F.explode(F.arrays_zip(F.regexp_extract_all(code, pattern, 1).alias("n"), F.regexp_extract_all(code, pattern, 2).alias("f"))).alias("r"))
    return rows.select("path", F.col("r.f").alias("name"), F.when(F.col("r.n") != "", "constructor").otherwise("call").alias("kind"))
