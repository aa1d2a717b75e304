import pytest

from quarrylight.operators import pages as P


def rows_of(spark, html, f):
    return f(P.tokens(spark.createDataFrame([(1, html)], "id long, html string")))


@pytest.mark.parametrize(("html", "want"), [
    ("a<b>c</b>", [("text", ""), ("open", "b"), ("text", ""), ("close", "b")]),
    ('<a title="x>y" b=\'>\'>', [("open", "a")]),
    ("<!-- <a> --><p", [("comment", ""), ("broken", "p")]),
    ("<script>if (a<b) '</p>'</SCRIPT >x", [("open", "script"), ("raw", "script"), ("close", "script"), ("text", "")]),
    ("<!-- no end <p>", [("comment", "")]), ('<a "unclosed>', [("broken", "a")]), ("<plaintext><p></plaintext>", [("open", "plaintext"), ("raw", "plaintext")]),
    ("<title></title>< x>", [("open", "title"), ("close", "title"), ("open", "")]), ("<", [("broken", "")]), ("", []),
])
def test_tokens(html, want):
    got = list(P.tokenize(html))
    assert [(k, t) for k, t, *_ in got] == want
    assert "".join(html[x:y] for *_, x, y in got) == html


def test_attributes():
    (_, _, found, *_), = P.tokenize("<input NAME = 'a b' value=\"x>y\" checked data-x=1/2 name=second value>")
    assert dict(found) == {"name": "a b", "value": "x>y", "checked": None, "data-x": "1/2"}


FORM = """<!-- <form><input name=ghost></form> --><form class="a>b" ACTION='/s?x=1' method=post><input type=hidden name=csrf_token value=t1>
<input name="q" value="1 > 0"><input name=q value=2><input type=checkbox name=c><input type=radio name=r checked><input type=submit name=go>
<input name=off disabled><form><input type=file name=f></form><select name=s><option disabled>no<option value=v1>one<option selected> two </select></form>
<form><select name=m multiple><option value=1></select><select name=first><option> a&amp;b</option><option>plain</option></select><textarea name=t> <b> </textarea><textarea name=u> hi
</textarea></form><script>"<form><input name=js></form>"</script><form method=PUT><input type=hidden name=page_token></form><form method=delete><input name=open"""


def test_forms(spark):
    got = sorted(rows_of(spark, FORM, P.forms).collect(), key=lambda r: r["place"])
    assert [(r["action"], r["method"], r["parameters"], r["hidden"], r["protected"], r["defaults"]) for r in got] == [
        ("/s?x=1", "POST", ["c", "csrf_token", "f", "q", "r"], ["csrf_token"], ["c", "csrf_token", "f", "r"], {"csrf_token": "t1", "q": "2", "r": "on"}),
        (None, "GET", ["first", "m", "t", "u"], [], ["m"], {"first": "plain", "u": "hi"}),
        (None, "PUT", ["page_token"], ["page_token"], ["page_token"], {}),
    ]
    assert [r["method"] for r in P.unprotected_forms(rows_of(spark, FORM, P.forms)).collect()] == ["PUT"]


def test_select_of_a_form(spark):
    html = "<form><select name=s><option disabled>no<option value=v1>one<option selected> two </select></form>"
    assert [r["defaults"] for r in rows_of(spark, html, P.forms).collect()] == [{"s": "two"}]


@pytest.mark.parametrize(("source", "want"), [
    ("fetch('/a'); axios.post(\"/b\")", [("GET", "/a"), ("POST", "/b")]),
    ("// fetch('/c')\n/* fetch('/d') */ const s = \"fetch('/e')\"", []),
    ("fetch(`/t`); fetch('/x' + y); fetch('/q', {method: 'PUT'}); fetch('/r', {method: 'PUT', body: 1})", [("PUT", "/q")]),
    ("const r = /fetch('a')/; fetch('/z')", []), ("x = a / b; fetch('/z')", []), ("fetch('/open", []), ("/* open fetch('/z')", []),
    ("window.fetch('/w'); my.fetch('/m'); a.window.fetch('/n'); await fetch('/k'); function fetch('/f')", [("GET", "/w"), ("GET", "/k")]),
    ("fetch('a\\'b'); axios.request('/v'); axios.GET('/u'); fetch(''); fetch('/a'); fetch('/a')", [("GET", "/a")]),
    ("`${fetch('/in')}`; axios . get ( '/s' )", [("GET", "/s")]), ("", []),
])
def test_calls(source, want):
    assert P.calls(source) == want


def test_calls_of_pages(spark):
    html = "<script type='text/template'>fetch('/t')</script><script>fetch('/a')</script><script type=module src=' /j.js '>axios.get('/b')</script><!-- <script>fetch('/c')</script> -->"
    assert sorted((r["method"], r["target"]) for r in rows_of(spark, html, P.script_calls).collect()) == [("GET", "/a"), ("GET", "/b")]
    assert [r["source"] for r in rows_of(spark, html, P.script_sources).collect()] == ["/j.js"]


CONTEXTS = [("<p>M", "markup"), ('<a title="x>y M', "attribute"), ("<a title='M'>", "attribute"), ("<script>var a='M'</script>", "script"), ('<script type="text/template">M', "inert"),
            ("<script type=Text/JavaScript>M", "script"), ("<iframe>M</iframe>", "inert"), ("<style>M</style>", "markup"), ("<!-- M -->", "inert"), ("<!-- x -->M", "markup"), ("<title>M", "inert"),
            ("none", "inert"), (None, "inert"), ("", "inert"), ("<script></script>M", "markup"), ("<textarea></p>M</textarea>", "inert"), ("\U0001f600é<b M>", "attribute")]


def test_reflection_contexts(spark):
    df = spark.createDataFrame([(i, h, "M") for i, (h, _) in enumerate(CONTEXTS)], "id long, html string, marker string")
    got = {r["id"]: r["context"] for r in P.reflection_contexts(df).collect()}
    assert got == {i: c for i, (_, c) in enumerate(CONTEXTS)}


def test_marker_that_opens_a_tag(spark):
    df = spark.createDataFrame([(1, "a<M>", "<M"), (2, "<p><!--M", "<!--M")], "id long, html string, marker string")
    assert {r["context"] for r in P.reflection_contexts(df).collect()} == {"markup"}


def test_forms_need_only_their_tokens(spark):
    """What is left out before tokens are written and ordered changes no form; a text that follows no option's mark is none of it."""
    html = FORM + "<p>far</p><form action=/z><select name=s><option>a<b>x</b>y</option> z<option selected>k</select><textarea name=t> n </textarea></form>"
    pages = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    few = P.tokens(pages, P.FORM_TAGS)
    assert {r["tag"] for r in few.collect()} <= {"", *P.FORM_TAGS} and few.count() < P.tokens(pages).count()
    rows = lambda t: sorted(map(str, P.forms(t).collect()))
    assert rows(few) == rows(P.tokens(pages))
