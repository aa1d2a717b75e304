import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import catalog as C
from quarrylight.sources import repository as R
from quarrylight.sources.sampling import stride_sample
from quarrylight.streaming import events as E


def test_catalog(spark, tmp_path):
    good = {"schema_version": 1, "datasets": [{"id": "a", "files": [{"path": "data/test-00.parquet", "size_bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}]}], "routes": {"scan": ["a"]}}
    bad = {"schema_version": 2, "datasets": [{"id": "a", "files": [{"path": "../x"}]}, {"id": "a", "files": []}], "routes": {"scan": ["b"]}}
    for name, doc in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    g, b = (C.load_catalog(spark, str(tmp_path / f"{n}.json")) for n in ("good", "bad"))
    assert C.catalog_violations(g).collect() == []
    assert {r["rule"] for r in C.catalog_violations(b).collect()} == {"schema_version", "duplicate_id", "unsafe_path", "unknown_route"}
    assert [r["dataset"] for r in C.route(g, "scan").collect()] == ["a"] and C.route(g, "none").count() == 0
    files = C.files_of(g)
    assert C.files_of_split(files, "test").count() == 1
    for content, status in ((b"abc", "ready"), (b"abd", "integrity_failed")):
        assert C.integrity(files, spark.createDataFrame([("data/test-00.parquet", content)], "path string, content binary")).first()["status"] == status
    assert C.integrity(files, spark.createDataFrame([], "path string, content binary")).first()["status"] == "not_installed"
    rows = spark.createDataFrame([("data/test-00.parquet", "test"), ("small/test-001-of-002.parquet", "small/test"), ("x/train.parquet", "x/train")], "path string, want string")
    assert all(r[0] for r in rows.select(C.split_of(F.col("path")) == F.col("want")).collect())


def test_walk(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in (("a.py", b"x=1"), ("b.bin", b"\x00\x01"), ("node_modules/c.js", b"1")):
        (tmp_path / name).write_bytes(data)
    files = R.walk(spark, str(tmp_path))
    got = {r["path"]: (r["language"], r["bin"]) for r in files.withColumn("bin", R.is_binary(F.col("content"))).collect()}
    assert got == {"a.py": ("Python", False), "b.bin": (None, True)} and R.walk_guard(files).first()["within_bounds"]


def test_binary_contents_beyond_the_first_block(spark):
    df = spark.createDataFrame([("a" * 9000 + "\x00",), ("a" * 9000,), ("",), ("\u0100\u3000",)], "t string").select(F.encode("t", "UTF-8").alias("c"))
    assert [tuple(r) for r in df.select(R.is_binary(F.col("c")), R.is_binary(F.col("c"), None)).collect()] == [(False, True), (False, False), (False, False), (False, False)]


def test_lock_files(spark):
    texts = {
        "requirements.txt": "A_b[x]==1.2 # c\nflask>=2\nq === 3 ; python\n", "go.mod": "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire x.y/z v0.1\n",
        "Cargo.lock": 'version = 3\n[[package]]\nname = "serde"\nversion = "1.0"\n\n[[package]]\nname = "libc"\nversion = "0.2"\n[metadata]\nname = "no"\nversion = "9"\n',
        "yarn.lock": '# v1\n\n"@a/b@^1.0", "@a/b@^1.1":\n  version "1.2.0"\nleft@^1:\n  version "1.0"\n', "Gemfile.lock": "GEM\n  specs:\n    rack (2.1)\n      x (>= 1)\nPLATFORMS\n    no (1)\n",
        "package-lock.json": json.dumps({"packages": {"": {"version": "0"}, "node_modules/@a/b": {"version": "1.0", "dev": True}, "node_modules/x/node_modules/y": {"version": "2.0"}}}),
        "composer.lock": json.dumps({"packages": [{"name": "a/b", "version": "v1.0"}], "packages-dev": [{"name": "c/d", "version": "2"}]}),
    }
    df = spark.createDataFrame([(f"p/{k}", v) for k, v in texts.items()], "path string, text string")
    got = {(r["ecosystem"], r["name"], r["version"], r["is_dev"]) for r in R.parse_manifests(df).collect()}
    assert got == {("PyPI", "A_b", "1.2", False), ("PyPI", "q", "3", False), ("Go", "github.com/a/b", "1.2.3", False), ("Go", "x.y/z", "0.1", False), ("crates.io", "serde", "1.0", False),
                   ("crates.io", "libc", "0.2", False), ("npm", "@a/b", "1.2.0", False), ("npm", "left", "1.0", False), ("RubyGems", "rack", "2.1", False), ("npm", "@a/b", "1.0", True),
                   ("npm", "y", "2.0", False), ("Packagist", "a/b", "1.0", False), ("Packagist", "c/d", "2", True)}


def test_stride_sample(spark):
    for n in (0, 1, 9, 10, 11, 95):
        rows = stride_sample(spark.range(n).repartition(4), ["id"], 10).collect()
        stride = max(1, -(-n // 10))
        assert sorted(r["place"] for r in rows) == list(range(0, n, stride))[:10] and all(r["id"] == r["place"] for r in rows)


def test_stride_sample_of_more_rows_than_bounds_are_sampled_from(spark):
    rows = stride_sample(spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("lang")).repartition(40), ["id"], 300).collect()
    assert sorted(r["place"] for r in rows) == list(range(0, 200_000, 667)) and all(r["id"] == r["place"] for r in rows)


def test_streams(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"))
    q = E.windowed_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").agg(F.sum("n")).first()[0] == batch.count()
    latest, q = E.maintain_findings(stream, ["user_id", "event_type"])
    q.awaitTermination(120)
    assert spark.read.parquet(latest()).count() == batch.select("user_id", "event_type").distinct().count()


def test_stream_goes_on_after_a_restart(spark, sf_dir, tmp_path):
    """A second query on the same checkpoint starts from what the first one left."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    keys = ["user_id", "event_type"]
    for half in ("ts < TIMESTAMP '2024-01-08'", "ts >= TIMESTAMP '2024-01-08'"):
        batch.filter(half).coalesce(1).write.mode("append").parquet(folder)
        latest, q = E.maintain_findings(E.read_events(spark, folder), keys, checkpoint)
        q.awaitTermination(120)
    assert spark.read.parquet(latest()).count() == batch.select(*keys).distinct().count()


def test_a_tree_over_the_bounds_is_refused(spark, tmp_path, monkeypatch):
    for n in range(3):
        (tmp_path / f"{n}.py").write_bytes(b"x" * 10)
    monkeypatch.setattr(R, "MAX_FILE", 5)
    assert {r["state"] for r in R.walk(spark, str(tmp_path)).collect()} == {"oversize"}
    monkeypatch.setattr(R, "MAX_FILES", 2)
    with pytest.raises(OverflowError):
        R.walk(spark, str(tmp_path))
