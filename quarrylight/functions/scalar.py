"""Column expressions: identities, paths, text measures, labels, versions, scores, URLs and vectors. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def deterministic_id(namespace: str, *parts: Column) -> Column:
    """namespace:sha256 over the namespace, then every part's 8-byte big-endian byte length and bytes."""
    framed = [F.encode(F.lit(namespace), "UTF-8")]
    for p in parts:
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), F.encode(p, "UTF-8")]
    return F.concat(F.lit(namespace + ":"), F.sha2(F.concat(*framed), 256))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of NUL-terminated parts."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.encode(p, "UTF-8"), F.unhex(F.lit("00")))]), 256)


def normalize_path(path: Column) -> Column:
    """Relative path with / separators and . and .. folded; null if absolute, drive-like or outside the root."""
    p = F.translate(path, "\\", "/")
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("s"))

    def step(acc: Column, seg: Column) -> Column:
        n = F.size(acc["s"])
        up = F.struct((acc["ok"] & (n > 0)).alias("ok"), F.slice(acc["s"], F.lit(1), F.greatest(n - 1, F.lit(0))).alias("s"))
        return F.when(seg.isin("", "."), acc).when(seg == "..", up).otherwise(F.struct(acc["ok"].alias("ok"), F.concat(acc["s"], F.array(seg)).alias("s")))

    folded = F.aggregate(F.split(p, "/"), start, step)
    return F.when(p.startswith("/") | p.rlike("^[A-Za-z]:"), None).otherwise(let(folded, lambda f: F.when(f["ok"], F.array_join(f["s"], "/"))))


def shannon_entropy(text: Column) -> Column:
    """Bits per byte: one sort of the bytes, no rows are exploded."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.substring(F.hex(F.encode(text, "UTF-8")), 2 * i - 1, F.lit(2)))

    def entropy(c: Column) -> Column:
        n = F.size(c).cast("double")
        shares = F.transform(F.array_distinct(c), lambda b: F.size(F.filter(c, lambda x: x == b)) / n)
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.octet_length(text) == 0, F.lit(0.0)).otherwise(let(codes, entropy))


def redact(text: Column) -> Column:
    return F.when(F.length(text) < 12, F.lit("********")).otherwise(F.concat(F.substring(text, 1, 4), F.lit("…"), F.right(text, F.lit(2))))


#: fixed values: parts and whole words of stand-in credentials
PLACEHOLDER_PARTS = [
    "example", "changeme", "change_me", "change-me", "changethis", "your", "xxxx", "placeholder", "dummy", "sample",
    "redacted", "replace", "insert", "todo", "fake", "notreal", "secret123", "password123", "****", "....",
]
PLACEHOLDER_WORDS = ["secret", "password", "passwd", "pass", "pwd", "postgres", "mysql", "root", "admin", "test", "user", "guest", "default"]


def is_placeholder(text: Column) -> Column:
    low = F.lower(text)
    tests = [F.contains(low, F.lit(p)) for p in PLACEHOLDER_PARTS]
    tests += [low.isin(PLACEHOLDER_WORDS), text.startswith("{") & text.endswith("}"), *[F.contains(text, F.lit(p)) for p in ("%s", "%(", "${", "{{")]]
    tests += [text.startswith("$"), text.startswith("<"), *[low.startswith(p) for p in ("process.env", "os.environ", "env(")], text.rlike(r"^(.)\1*$")]
    return reduce(lambda a, b: a | b, tests)


#: fixed values: texts of labels, names of languages
TRUE_LABELS = ["1", "true", "yes", "vulnerable", "vuln", "insecure", "bad", "unsafe"]
FALSE_LABELS = ["0", "false", "no", "safe", "secure", "benign", "clean", "good", "not vulnerable", "non vulnerable", "fixed"]
LANGUAGE_NAMES = {
    "C": "c", "C++": "c++ cpp cxx cc", "Python": "python py python3", "JavaScript": "javascript js node nodejs", "TypeScript": "typescript ts", "TypeScript TSX": "tsx",
    "Go": "go golang", "Rust": "rust rs", "PHP": "php", "Java": "java", "C#": "c# csharp cs", "Ruby": "ruby rb", "Kotlin": "kotlin kt", "Swift": "swift",
}


def parse_label(text: Column) -> Column:
    t = F.translate(F.lower(F.trim(text)), "-_", "  ")
    return F.when(t.isin(TRUE_LABELS), True).when(t.isin(FALSE_LABELS), False)


def parse_cwes(text: Column) -> Column:
    """Sorted distinct CWE-n of a text: its alphanumeric tokens of up to five digits, with or without CWE before them."""
    digits = F.transform(F.split(text, "[^A-Za-z0-9]+"), lambda t: F.regexp_extract(t, r"^(?:CWE|cwe)?([0-9]{1,5})$", 1))
    numbers = F.filter(F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int")), lambda n: n > 0)
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("CWE-"), n.cast("string")))))


def normalize_language(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return reduce(lambda w, kv: w.when(low.isin(kv[1].split()), kv[0]), LANGUAGE_NAMES.items(), F.when(F.lit(False), "")).otherwise(F.trim(text))


def normalize_name(ecosystem: Column, name: Column) -> Column:
    return F.when(ecosystem == "PyPI", F.regexp_replace(F.lower(name), "[-_.]+", "-")).when(ecosystem.isin("Packagist", "NuGet"), F.lower(name)).otherwise(name)


def version_key(version: Column) -> Column:
    """A sortable struct: release numbers without trailing zeros, releases after pre-releases, pre-release parts."""
    number = "decimal(20,0)"
    big = F.lit("18446744073709551615")
    clip = lambda d: F.when(F.length(F.ltrim(d, F.lit("0"))) > 20, big).otherwise(d).cast(number)
    v = F.split_part(F.regexp_replace(F.trim(version), "^[vV]+", ""), F.lit("+"), F.lit(1))
    head = F.regexp_extract(v, r"^([0-9]+(?:\.[0-9]+)*)?", 0)
    rest = F.lower(F.regexp_replace(F.substr(v, F.length(head) + 1), r"^[-._]+", ""))
    released = (rest == "") | rest.startswith("post") | rest.isin("final", "ga", "release") | rest.startswith("sp")
    numbers = F.transform(F.filter(F.split(head, r"\."), lambda d: d != ""), clip)
    kept = F.aggregate(F.reverse(numbers), F.array().cast(f"array<{number}>"), lambda a, d: F.when((F.size(a) == 0) & (d == 0), a).otherwise(F.concat(F.array(d), a)))
    part = lambda p: F.struct(F.when(p.rlike("^[0-9]{1,19}$"), 0).otherwise(1).alias("kind"), F.when(p.rlike("^[0-9]{1,19}$"), p).otherwise("0").cast(number).alias("num"), F.when(p.rlike("^[0-9]{1,19}$"), "").otherwise(p).alias("txt"))
    pre = F.when(released, F.array().cast(f"array<struct<kind:int,num:{number},txt:string>>")).otherwise(F.transform(F.split(rest, "[.-]"), part))
    return F.struct(kept.alias("release"), F.when(released, 1).otherwise(0).alias("final"), pre.alias("pre"))


#: what a range's events may do: open an interval or close it
OPENS, CLOSES = "introduced", ["fixed", "limit", "last_affected"]


def intervals(events: Column) -> Column:
    """array<struct<start, stop, inclusive>> of events array<struct<kind, value>>, in their order; null start or stop: unbounded.

    An opening event followed by a closing one is an interval, one followed by nothing is open; one followed by another opening
    event is overwritten, and a closing event without one before it closes nothing. Opening at "0" is before every version.
    """
    known = F.filter(events, lambda e: e["kind"].isin(OPENS, *CLOSES) & e["value"].isNotNull())
    none = F.lit(None).cast("string")

    def of(known: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            then = F.get(known, i + 1)
            interval = F.struct(F.when(e["value"] != "0", e["value"]).otherwise(none).alias("start"), then["value"].alias("stop"), F.coalesce(then["kind"] == "last_affected", F.lit(True)).alias("inclusive"))
            return F.when((e["kind"] == OPENS) & (then.isNull() | (then["kind"] != OPENS)), interval)

        return F.array_compact(F.transform(known, one))

    return let(known, of)


def version_affected(version: Column, events: Column) -> Column:
    """Whether version lies in an interval of events array<struct<kind, value>>."""

    def inside(key: Column) -> Column:
        after = lambda i: i["start"].isNull() | (key >= version_key(i["start"]))
        before = lambda i: i["stop"].isNull() | F.when(i["inclusive"], key <= version_key(i["stop"])).otherwise(key < version_key(i["stop"]))
        return F.exists(intervals(events), lambda i: after(i) & before(i))

    return let(version_key(version), inside)


def cvss3_base_score(vector: Column) -> Column:
    """CVSS 3.x base score; null where a metric is missing or unknown."""
    return let(vector, _cvss3)  # one interpreted expression: as generated code it would be beyond what the JVM compiles


def _cvss3(vector: Column) -> Column:
    def weights(parts: Column) -> Column:
        pick = lambda n, **values: reduce(lambda w, kv: w.when(F.try_element_at(parts, F.lit(n)) == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(0.0)))
        scope = F.try_element_at(parts, F.lit("S"))
        privileges = F.when(scope == "C", pick("PR", N=0.85, L=0.68, H=0.5)).otherwise(pick("PR", N=0.85, L=0.62, H=0.27))
        c, i, a = (pick(n, H=0.56, L=0.22, N=0.0) for n in "CIA")
        iss = 1.0 - (1.0 - c) * (1.0 - i) * (1.0 - a)
        exploit = 8.22 * pick("AV", N=0.85, A=0.62, L=0.55, P=0.2) * pick("AC", L=0.77, H=0.44) * privileges * pick("UI", N=0.85, R=0.62)
        return F.struct(scope.alias("scope"), iss.alias("iss"), exploit.alias("exploit"))

    def score(w: Column) -> Column:
        changed, iss = w["scope"] == "C", w["iss"]
        impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
        return let(F.struct(w["scope"].alias("scope"), changed.alias("changed"), impact.alias("impact"), w["exploit"].alias("exploit")), rounded)

    def rounded(w: Column) -> Column:
        total = w["impact"] + w["exploit"]
        raw = F.least(F.when(w["changed"], 1.08 * total).otherwise(total), F.lit(10.0))
        up = let(F.round(raw * 100000.0).cast("long"), lambda s: F.when(s % 10000 == 0, s / 100000.0).otherwise((F.floor(s / 10000) + 1) / 10.0))
        whole = w["impact"].isNotNull() & w["exploit"].isNotNull()
        return F.when(vector.startswith("CVSS:3.") & w["scope"].isNotNull(), F.when(whole, F.when(w["impact"] <= 0, 0.0).otherwise(up)))

    return let(F.str_to_map(vector, F.lit("/"), F.lit(":")), lambda parts: let(weights(parts), score))


def severity_band(score: Column) -> Column:
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").otherwise("low")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL; null for ecosystems without a type."""
    kinds = {"npm": "npm", "crates.io": "cargo", "PyPI": "pypi", "Go": "golang", "Packagist": "composer", "RubyGems": "gem", "Maven": "maven", "NuGet": "nuget"}
    kind = reduce(lambda w, kv: w.when(ecosystem == kv[0], F.lit(kv[1])), kinds.items(), F.when(F.lit(False), F.lit("")))
    quote = lambda c: F.regexp_replace(F.regexp_replace(F.url_encode(c), r"\+", "%20"), r"\*", "%2A")
    path = F.array_join(F.transform(F.split(F.when(ecosystem == "Maven", F.translate(name, ":", "/")).otherwise(normalize_name(ecosystem, name)), "/"), quote), "/")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.lit("@"), quote(version))


def lexical_vector(text: Column, dims: int = 64, most: int = 48) -> Column:
    """L2-normalised counts of hashed tokens: SHA-256's first two bytes modulo dims."""
    tokens = F.slice(F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda t: t != ""), 1, most)
    places = F.transform(tokens, lambda t: (F.conv(F.substring(F.sha2(t, 256), 1, 4), 16, 10).cast("int") % dims))

    def normal(p: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(p, lambda x: x == d)).cast("double"))
        return let(counts, lambda c: F.transform(c, lambda x: x / F.greatest(norm(c), F.lit(1e-300))))

    return let(places, normal)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_problem(v: Column, least: int = 16, most: int = 3072) -> Column:
    """Why a vector can't be stored, or null."""
    return (
        F.when(~F.size(v).between(least, most), "dimensions")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e6)), "not_finite")
        .when(F.forall(v, lambda x: x == 0), "zero")
    )


SENSITIVE = "^(token|access_token|auth|password|passwd|pwd|secret|api_key|apikey|key|session|sid|code|ref)$"


def redact_url(url: Column, sensitive: str = SENSITIVE) -> Column:
    """Query values of sensitive keys become REDACTED; the fragment goes."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.split_part(bare, F.lit("?"), F.lit(2))
    one = lambda p: F.when(F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(sensitive) & F.contains(p, F.lit("=")), F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("=REDACTED"))).otherwise(p)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), F.array_join(F.transform(F.split(query, "&"), one), "&")))


def join_routes(prefix: Column, path: Column) -> Column:
    return F.concat(F.lit("/"), F.trim(F.regexp_replace(F.concat(prefix, F.lit("/"), path), "/+", "/"), F.lit("/")))


def safe_excerpt(line: Column, most: int = 240) -> Column:
    """A line with string literals and URL credentials blanked, cut to `most` characters."""
    t = F.regexp_replace(F.regexp_replace(F.trim(line), r"(://)[^/@\s]+@", "$1***@"), r"(['\"])(?:(?!\1).){4,}\1", "$1***$1")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def certificate_state(start: Column, stop: Column, now: Column, soon: int = 30) -> Column:
    days = F.floor((F.unix_timestamp(stop) - F.unix_timestamp(now)) / 86400)
    return F.when(start > now, "not_yet_valid").when(stop <= now, "expired").when(days <= soon, "expiring_soon").otherwise("valid")


def softmax(logits: Column) -> Column:
    shifted = let(logits, lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))
    return let(shifted, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def image_is_mutable(image: Column) -> Column:
    """An image without a tag, with an empty one or with latest in any case, not pinned by digest and not parameterised."""
    last = F.element_at(F.split(image, "/"), -1)
    return ~F.contains(image, F.lit("@sha256:")) & ~F.contains(image, F.lit("${")) & last.rlike("(?i)^[^:]*(:|:latest)?$")


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, / for an empty path."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    part = lambda k: F.regexp_extract(url, parts, k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    return F.when(url.rlike(parts), F.concat(scheme, F.lit("://"), host, F.when(part(3) == "", "/").otherwise(part(3)), part(4)))


def cwe_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.upper(text), F.lit("CWE-([0-9]{1,9})"), 1), lambda n: n.cast("long"))))


def severity_name(text: Column) -> Column:
    """critical, high, medium (or moderate), low, none; anything else is unknown."""
    low = F.lower(F.trim(text))
    return F.when(low == "moderate", "medium").when(low.isin("critical", "high", "medium", "low", "none"), low).otherwise("unknown")


def strip_router_prefix(path: Column, prefix: Column) -> Column:
    """A route without a leading router prefix, whole segments only."""
    at = F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"))
    return F.when(F.rtrim(path, F.lit("/")) == F.rtrim(prefix, F.lit("/")), "/").when(path.startswith(at), F.concat(F.lit("/"), F.substr(path, F.length(at) + 1))).otherwise(path)


def declaration_head(source: Column) -> Column:
    """What stands before a declaration's body, on one line; null if nothing does."""
    head = F.trim(F.regexp_replace(F.regexp_extract(source, r"(?s)^([^{;]*)", 1), r"\s+", " "))
    return F.nullif(F.rtrim(head, F.lit(": ")), F.lit(""))


def ip_class(ip: Column) -> Column:
    v4 = F.transform(F.split(ip, r"\."), lambda x: x.cast("int"))
    private = (v4[0] == 10) | ((v4[0] == 172) & v4[1].between(16, 31)) | ((v4[0] == 192) & (v4[1] == 168))
    six = F.contains(ip, F.lit(":"))
    return (
        F.when(six, F.when(ip.rlike("^(0*:){2,}0*1$"), "loopback").when(F.lower(ip).rlike("^f[cd][0-9a-f]{2}:"), "private").otherwise("public"))
        .when(v4[0] == 127, "loopback").when(private, "private").otherwise("public")
    )


def title_case(text: Column) -> Column:
    """First letter in upper case, the rest as it is; Root for an empty text."""
    return F.when(text == "", "Root").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2))))


#: fixed values: parts of parameter names
REDIRECT_NAMES = ["next", "url", "redirect", "redirect_uri", "return", "return_to", "callback"]
PATH_NAMES = ["file", "path", "template", "page", "download", "folder"]
URL_NAMES = ["url", "uri", "endpoint", "webhook", "callback", "image", "avatar", "feed"]
OBJECT_NAMES = ["id", "user", "account", "order", "document", "file", "record"]


def named_like(name: Column, parts: list[str]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def object_specific(names: Column, path: Column) -> Column:
    """A parameter named like an object, or a path segment of two or more digits."""
    return F.exists(names, lambda n: named_like(n, OBJECT_NAMES)) | path.rlike("(^|/)[0-9]{2,}(/|$)")


#: fixed values: what databases' error messages hold
SQL_ERRORS = ["sql syntax", "sqlstate", "sqlite error", "sqliteexception", "postgresql error", "pg::syntaxerror", "mysql_fetch", "mysqli_sql_exception", "ora-", "unclosed quotation mark", "syntax error at or near", "database query failed"]


def has_sql_error(body: Column) -> Column:
    return F.lower(body).rlike("|".join(SQL_ERRORS))
