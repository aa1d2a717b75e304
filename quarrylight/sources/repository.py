"""Source trees and dependency lock files as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed values: folders that are not walked, and languages by extension
PRUNED = [".git", "node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__", ".next", "vendor"]
LANGUAGES = {"ts": "TypeScript", "tsx": "TSX", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "py": "Python", "rs": "Rust", "go": "Go", "php": "PHP", "c": "C", "h": "C", "java": "Java"}
MAX_FILE, MAX_FILES, MAX_TOTAL = 5 << 20, 20_000, 256 << 20


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return reduce(lambda w, kv: w.when(ext == kv[0], F.lit(kv[1])), LANGUAGES.items(), F.when(F.lit(False), F.lit("")))


def is_binary(content: Column, within: int | None = 8192) -> Column:
    """A NUL byte in the first 8 KiB, or in the first `within` bytes, or anywhere if that is None."""
    return F.contains(content if within is None else F.substring(content, 1, within), F.unhex(F.lit("00")))


def classify_files(files: DataFrame) -> DataFrame:
    """files(path, length): path, language and state (read, or oversize for files over MAX_FILE) of what lies in no pruned folder."""
    kept = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(p) for p in PRUNED])))
    return kept.select("path", language_of(F.col("path")).alias("language"), F.when(F.col("length") <= MAX_FILE, "read").otherwise("oversize").alias("state"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, length, content_hash, language, state of every source file under root.

    Files over MAX_FILE have state oversize and no content. Raises OverflowError if the tree is over the bounds; sizes come
    from the listing, so no content is read for that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.removeprefix("file:").rstrip("/") + "/", "")
    files = files.withColumn("path", rel)
    listed = files.select("path", "length").join(classify_files(files.select("path", "length")), "path")
    if not walk_guard(listed).first()["within_bounds"]:
        raise OverflowError(f"{root} has more than {MAX_FILES} files or {MAX_TOTAL} bytes")
    kept = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(p) for p in PRUNED])))
    small = F.col("length") <= MAX_FILE
    content = F.when(small, F.col("content"))
    return kept.select("path", content.alias("content"), "length", F.sha2(content, 256).alias("content_hash"), language_of(F.col("path")).alias("language"), F.when(small, "read").otherwise("oversize").alias("state"))


def walk_guard(files: DataFrame) -> DataFrame:
    """One row: files, bytes and whether the bounds hold."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("within_bounds", (F.col("files") <= MAX_FILES) & (F.col("bytes") <= MAX_TOTAL))


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """path, line (from 1), source: as DataFrame rows; a final newline adds no line."""
    body = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n$", "")
    return files.select("path", F.posexplode(F.split(body, "\n")).alias("_i", "source")).select("path", (F.col("_i") + 1).alias("line"), "source")


def _dep(df: DataFrame, ecosystem: str, name: Column, version: Column, dev: Column | None = None) -> DataFrame:
    out = df.select(F.col("path").alias("manifest_path"), F.lit(ecosystem).alias("ecosystem"), name.alias("name"), version.alias("version"), (dev if dev is not None else F.lit(False)).alias("is_dev"))
    return out.filter(F.col("name").isNotNull() & (F.col("name") != "") & F.col("version").isNotNull() & (F.col("version") != ""))


def parse_requirements(files: DataFrame) -> DataFrame:
    lines = lines_of(files).select("path", F.regexp_replace("source", r"\s*(#|;).*$", "").alias("s"))
    return _dep(lines, "PyPI", F.regexp_extract("s", r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*===?\s*([^\s,]+)\s*$", 1), F.regexp_extract("s", r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*===?\s*([^\s,]+)\s*$", 2))


def parse_go_mod(files: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("source").rlike(r"^\s*require\s*\("), True).when(F.col("source").rlike(r"^\s*\)"), False)
    lines = lines_of(files).withColumn("_in", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(False)))
    pattern = r"^\s*(?:require\s+)?([^\s()]+\.[^\s()]+)\s+v([^\s/]+)"
    return _dep(lines.filter(F.col("_in") | F.col("source").rlike(r"^\s*require\s+[^(]")), "Go", F.regexp_extract("source", pattern, 1), F.regexp_extract("source", pattern, 2))


def parse_toml_packages(files: DataFrame, ecosystem: str) -> DataFrame:
    """[[package]] tables of Cargo, Poetry and uv locks: the name and version that follow one header."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("source").rlike(r"^\s*\["), F.struct(F.col("line").alias("at"), F.col("source").rlike(r"^\s*\[\[package\]\]").alias("package")))
    lines = lines_of(files).withColumn("_h", F.last(head, ignorenulls=True).over(w)).filter("_h.package")
    field = lambda k: F.max(F.when(F.col("source").rlike(rf"^{k}\s*="), F.regexp_extract("source", rf'^{k}\s*=\s*"([^"]*)"', 1)))
    packages = lines.groupBy("path", "_h.at").agg(field("name").alias("n"), field("version").alias("v"), field("category").alias("c"))
    return _dep(packages, ecosystem, F.col("n"), F.col("v"), F.coalesce(F.col("c") == "dev", F.lit(False)))


def parse_yarn_lock(files: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("source").rlike(r"^\S.*:\s*$") & ~F.col("source").startswith("#"), F.regexp_extract("source", r'^"?(@?[^@",]+)@', 1))
    lines = lines_of(files).withColumn("_n", F.last(head, ignorenulls=True).over(w))
    version = F.regexp_extract("source", r'^  version:?\s+"?([^"\s]+)"?', 1)
    return _dep(lines, "npm", F.col("_n"), version)


def parse_gemfile_lock(files: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines_of(files).withColumn("_s", F.last(F.when(F.col("source").rlike(r"^[A-Z]"), F.col("source")), ignorenulls=True).over(w))
    pattern = r"^    ([^\s(]+) \(([^)\s]+)\)\s*$"
    return _dep(lines.filter("_s = 'GEM'"), "RubyGems", F.regexp_extract("source", pattern, 1), F.regexp_extract("source", pattern, 2))


def parse_npm_lock(files: DataFrame) -> DataFrame:
    """Versions 2 and 3 (packages) and 1 (dependencies, top level)."""
    new = "struct<packages:map<string,struct<version:string,dev:boolean>>, dependencies:map<string,struct<version:string,dev:boolean>>>"
    doc = files.select("path", F.from_json("text", new).alias("d"))
    entries = doc.select("path", F.explode(F.coalesce(F.map_entries("d.packages"), F.map_entries("d.dependencies"))).alias("e"))
    return _dep(entries, "npm", F.regexp_extract("e.key", r"(?:^|.*node_modules/)((?:@[^/]+/)?[^/]+)$", 1), F.col("e.value.version"), F.coalesce("e.value.dev", F.lit(False)))


def parse_composer_lock(files: DataFrame) -> DataFrame:
    entry = "array<struct<name:string,version:string>>"
    doc = files.select("path", F.from_json("text", f"struct<packages:{entry}, `packages-dev`:{entry}>").alias("d"))
    rows = lambda c, dev: doc.select("path", F.explode(c).alias("e"), F.lit(dev).alias("dev"))
    both = rows("d.packages", False).unionByName(rows(F.col("d")["packages-dev"], True))
    return _dep(both, "Packagist", F.col("e.name"), F.regexp_replace("e.version", "^v", ""), F.col("dev"))


def parse_pnpm_lock(files: DataFrame) -> DataFrame:
    """Keys of the packages section, /name/version (version 5), /name@version (6) or name@version (9); peers in brackets or after _ go."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines_of(files).withColumn("_s", F.last(F.when(F.col("source").rlike(r"^\S"), F.col("source")), ignorenulls=True).over(w)).filter("_s LIKE 'packages:%'")
    key = F.when(F.col("source").rlike(r"^  \S.*:\s*(\{.*)?$"), F.regexp_extract("source", r"^  '?/?((?:@[^/']+/)?[^@/'(]+[@/][^'(_:]+)", 1))
    lines = lines.withColumn("_k", F.last(F.when(key.isNotNull(), F.struct(F.col("line").alias("at"), key.alias("k"))), ignorenulls=True).over(w))
    packages = lines.groupBy("path", "_k").agg(F.coalesce(F.max(F.col("source").rlike(r"^    dev: true")), F.lit(False)).alias("dev")).filter("_k.k <> ''")
    return _dep(packages, "npm", F.regexp_extract("_k.k", r"^((?:@[^/]+/)?[^@/]+)", 1), F.regexp_extract("_k.k", r"^(?:@[^/]+/)?[^@/]+[@/](.+)$", 1), F.col("dev"))


def parse_bun_lock(files: DataFrame) -> DataFrame:
    """packages: name to a list that starts with name@version; trailing commas are allowed in the file."""
    text = F.regexp_replace("text", r",(\s*[}\]])", "$1")
    entries = files.select("path", F.explode(F.from_json(F.get_json_object(text, "$.packages"), "map<string,array<string>>")).alias("k", "v"))
    return _dep(entries, "npm", F.regexp_extract(F.col("v")[0], r"^(@?[^@]+)@", 1), F.regexp_extract(F.col("v")[0], r"^@?[^@]+@([0-9][^@]*)$", 1))


def parse_pipfile_lock(files: DataFrame) -> DataFrame:
    part = lambda k, dev: files.select("path", F.explode(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,struct<version:string>>")).alias("k", "v"), F.lit(dev).alias("dev"))
    both = part("default", False).unionByName(part("develop", True))
    return _dep(both, "PyPI", F.col("k"), F.regexp_replace("v.version", "^==", ""), F.col("dev"))


def parse_gradle_lock(files: DataFrame) -> DataFrame:
    """group:name:version=configurations; dev if all of them are of tests."""
    pattern = r"^([^#:=\s]+:[^:=\s]+):([^:=\s]+)=(.*)$"
    part = lambda k: F.regexp_extract("source", pattern, k)
    return _dep(lines_of(files), "Maven", part(1), part(2), F.forall(F.split(part(3), ","), lambda c: F.lower(c).startswith("test")))


def parse_nuget_lock(files: DataFrame) -> DataFrame:
    frameworks = files.select("path", F.explode(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,map<string,struct<resolved:string>>>")).alias("f", "d"))
    return _dep(frameworks.select("path", F.explode("d").alias("k", "v")), "NuGet", F.col("k"), F.col("v.resolved"))


def parse_pom(files: DataFrame) -> DataFrame:
    """Dependencies with a version, literal or a property of the same file; test and provided scopes are dev."""
    text = F.regexp_replace("text", r"(?s)<!--.*?-->|<dependencyManagement>.*?</dependencyManagement>", "")
    body = files.select("path", F.regexp_extract_all(text, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1).alias("d"), F.regexp_extract(text, r"(?s)<properties>(.*?)</properties>", 1).alias("p"))
    tag = lambda c, t: F.trim(F.regexp_extract(c, rf"(?s)<{t}>([^<]*)</{t}>", 1))
    names = F.map_from_entries(F.array_distinct(F.transform(F.regexp_extract_all("p", F.lit(r"(?s)(<[\w.-]+>[^<]*<)"), 1), lambda x: F.struct(F.regexp_extract(x, r"<([\w.-]+)>", 1), F.trim(F.regexp_extract(x, r">([^<]*)<", 1))))))
    rows = body.select("path", names.alias("p"), F.explode("d").alias("d"))
    raw = tag("d", "version")
    version = F.when(raw.rlike(r"^\$\{[^}]+\}$"), F.try_element_at("p", F.regexp_extract(raw, r"^\$\{([^}]+)\}$", 1))).when(F.contains(raw, F.lit("${")), "").otherwise(raw)
    return _dep(rows, "Maven", F.concat(tag("d", "groupId"), F.lit(":"), tag("d", "artifactId")), version, tag("d", "scope").isin("test", "provided"))


def parse_msbuild(files: DataFrame) -> DataFrame:
    """PackageReference items with a literal version, as an attribute or an element."""
    item = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(<PackageReference\b(?:[^>]*/>|.*?</PackageReference>))"), 1)).alias("d")
    version = F.coalesce(F.nullif(F.regexp_extract("d", r'\bVersion\s*=\s*"([^"$]+)"', 1), F.lit("")), F.regexp_extract("d", r"<Version>([^<$]+)</Version>", 1))
    return _dep(files.select("path", item), "NuGet", F.regexp_extract("d", r'\bInclude\s*=\s*"([^"]+)"', 1), version)


#: fixed values: file names of manifests, as patterns
PARSERS = {
    r"requirements[^/]*\.txt": parse_requirements, r"go\.mod": parse_go_mod, r"Cargo\.lock": lambda f: parse_toml_packages(f, "crates.io"),
    r"(?:poetry|uv)\.lock": lambda f: parse_toml_packages(f, "PyPI"), r"yarn\.lock": parse_yarn_lock, r"Gemfile\.lock": parse_gemfile_lock,
    r"package-lock\.json": parse_npm_lock, r"composer\.lock": parse_composer_lock, r"pnpm-lock\.yaml": parse_pnpm_lock, r"bun\.lock": parse_bun_lock, r"Pipfile\.lock": parse_pipfile_lock,
    r"gradle\.lockfile": parse_gradle_lock, r"packages\.lock\.json": parse_nuget_lock, r"pom\.xml": parse_pom, r"[^/]+\.(?:cs|fs|vb)proj|Directory\.Packages\.props": parse_msbuild,
}
ARTIFACTS = {
    "sql": r"(?i)\.sql$", "prisma": r"(?i)\.prisma$", "dockerfile": r"(?i)(^|/)(Dockerfile(\.[^/]+)?|[^/]+\.dockerfile)$", "compose": r"(?i)(^|/)(docker-)?compose(\.[^/]+)?\.ya?ml$",
    "test_config": r"(?i)(^|/)(pytest\.ini|conftest\.py|(jest|vitest|playwright|cypress)\.config\.[cm]?[jt]s)$", "test": r"(?i)\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.(py|go)$|Tests?\.java$",
}


def artifact_kind(path: Column) -> Column:
    """What an artifact analyser reads this file as, or null."""
    return reduce(lambda w, kv: w.when(path.rlike(kv[1]), F.lit(kv[0])), ARTIFACTS.items(), F.when(F.lit(False), F.lit("")))


def parse_manifests(files: DataFrame) -> DataFrame:
    """Inventory of every known manifest of files(path, text)."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = [parse(files.filter(name.rlike(f"^(?:{kind})$"))) for kind, parse in PARSERS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("manifest_path", "ecosystem", "name", "version").agg(F.bool_and("is_dev").alias("is_dev"))
