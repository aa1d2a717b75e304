from quarrylight.operators import rules as R


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "path string, text string")


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sql(spark):
    text = "-- DROP TABLE x;\nDROP TABLE a;\n\nUPDATE t SET a = 'WHERE;' ;\nDELETE FROM t WHERE id = 1;\n/* ; */ PRAGMA foreign_keys = OFF;\nSELECT 1"
    assert found(R.sql_findings(files(spark, a__sql=text)), "line", "rule") == [(2, "sql.destructive_ddl"), (4, "sql.unbounded_write"), (6, "sql.foreign_keys_off")]


def test_prisma(spark):
    text = 'datasource db {\n  url = "postgres://x"\n}\nmodel A {\n  url = "x"\n}\ndatasource e {\n  url = env("X")\n}'
    assert found(R.prisma_findings(files(spark, s__prisma=text)), "line") == [(2,)]


def test_docker_and_compose(spark):
    assert found(R.dockerfile_findings(files(spark, Dockerfile="FROM node:latest\nFROM a@sha256:00 AS b\nHEALTHCHECK NONE")), "line", "rule") == [(1, "docker.mutable_image"), (3, "docker.healthcheck_disabled")]
    text = 'services:\n  web:\n    image: "nginx" # c\n    restart: "no"\n  db:\n    image: pg@sha256:1\n    healthcheck:\n      test: ["CMD"]\nvolumes:\n  v:\n    image: x\n'
    assert found(R.compose_findings(files(spark, c__yml=text)), "service", "rule") == [("web", "compose.mutable_image"), ("web", "compose.no_healthcheck"), ("web", "compose.no_restart")]


def test_lines(spark):
    df = files(spark, a__py="# app.run(debug=True)\napp.run(debug=True)\n", b__js="el.innerHTML = req.query.a\nos.system(1)\n  * el.innerHTML = req.query.a", c__php="echo $_GET['a'];", d__txt="csrf: FALSE")
    assert found(R.line_findings(df), "path", "line", "rule") == [("a.py", 2, "web.debug.enabled"), ("b.js", 1, "web.xss.request_to_html"), ("c.php", 1, "web.xss.request_to_html"), ("d.txt", 1, "web.csrf.disabled")]


def test_taint(spark):
    direct = 'q = request.args.get("x")\ns = "SELECT " + q\ncur.execute(s)\ncur.execute("SELECT ?", (q,))\nq = "safe"\ncur.execute(q)'
    assert found(R.taint_findings(files(spark, a__py=direct)), "line", "rule", "variable") == [(3, "web.sql.tainted_variable_to_query", "s")]
    assert R.taint_of_lines(["q = request.args['x']", *["pass"] * 41, "cur.execute(q)"]) == []
    assert R.taint_of_lines(["q = request.args['x']", *["pass"] * 39, "cur.execute(q)"]) == [(41, 0, "q", 1)]
    assert R.taint_of_lines(["# q = request.args['x']", "q = request.args['x']", "# cur.execute(q)", "x = y", "cur.execute('a', q)"], R.COMMENTS[".py"]) == []
    assert R.taint_of_lines(["const $a = req.query.n;", "let b = `x ${$a}`", "// res.set('h', $a)", "res.set('h', b)", "b = 1", "res.set('h', b)"], R.COMMENTS[".js"]) == [(4, 1, "b", 1)]


def test_findings_carry_evidence(spark):
    text = 'x = request.args["a"]\ncur.execute("SELECT " + x)  # password = "hunter2"\nDATABASE_URL = "postgres://me:pw@h/d?sslmode=disable"\n' + "app.run(debug=True)" + " " * 5 + "#" * 300
    rows = R.line_findings(files(spark, a__py=text)).unionByName(R.taint_findings(files(spark, a__py=text)).drop("variable", "source_line")).orderBy("line", "rule").collect()
    assert [(r["line"], r["rule"], r["severity"], r["cwe"], r["confidence"]) for r in rows] == [
        (2, "web.sql.dynamic_query", "high", "CWE-89", 0.96), (2, "web.sql.tainted_variable_to_query", "critical", "CWE-89", 0.94), (3, "web.database.connection_tls_disabled", "high", "CWE-319", 0.96), (4, "web.debug.enabled", "medium", "CWE-489", 0.96)
    ]
    assert rows[0]["excerpt"].endswith('password = "<redacted>"') and "me:<redacted>@h" in rows[2]["excerpt"] and len(rows[3]["excerpt"]) == 240 and len({r["fingerprint"] for r in rows}) == 4


def test_symbols_imports_routes(spark):
    df = spark.createDataFrame([("a.py", "Python", "import os\nfrom a.b import c\nclass A:\n    def f(self): pass\n@app.get('/x/{id}')\ndef g(): pass\nimport pytest"), ("b.ts", "TypeScript", "import x from './x'\nexport class B {}\nrouter.post('/y', f)")], "path string, language string, text string")
    assert found(R.symbols(df), "path", "kind", "name") == [("a.py", "class", "A"), ("a.py", "def", "f"), ("a.py", "def", "g"), ("b.ts", "class", "B")]
    assert found(R.imports(df), "path", "specifier") == [("a.py", "a.b"), ("a.py", "os"), ("a.py", "pytest"), ("b.ts", "./x")]
    assert found(R.routes(df), "method", "template") == [("GET", "/x/{id}"), ("POST", "/y")]
    assert found(R.test_frameworks(df), "path", "framework") == [("a.py", "pytest")]
