import base64
import hashlib

from quarrylight.llm import warc


def expected(rows):
    best = {}
    for k, _, h in rows:
        best[h or ""] = max(k, best.get(h or "", k))
    out = set()
    for k, _, h in rows:
        raw = (h or "").encode()
        r = best[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.add((k, len(raw), digest, "response" if r == k else "revisit", None if r == k else r))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)
    assert all(r["intact"] for r in got)
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == expected(rows)


def test_round_trip(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    odd = [(1000, None, None), (1001, "u", ""), (1002, "a b\r\nc", "x\r\n\r\ny"), (1003, "u", "é" * 3_000_000), (1004, "u", "same"), (1005, "u", "same"), (1006, "u", "same")]
    run(spark, rows + odd)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(df).count() == 0


def test_seek_table_reads_one_frame():
    w = warc.BundleWriter()
    for k in range(5):
        w.add(k, warc._record(k, "u", bytes([65 + k]) * 600_000, "D", k))
    places, bundle = w.places, w.finish()
    frames = warc.seek_table(bundle)
    assert len(frames) == 5
    key, frame, offset, length = places[3]
    data = warc.read_frame(bundle, frames[frame])[offset : offset + length]
    assert b"<urn:page:3>" in data and data.endswith(b"D" * 0 + b"\r\n\r\n")
