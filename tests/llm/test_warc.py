"""Round trips of the content-addressed archive."""

import base64
import gzip
import hashlib
from collections import Counter
from glob import glob

import pytest

from liftlake.llm import warc
from liftlake.llm.common import scratch

from llm_cases import tiny

PAGES = [(3, "http://a/x\r\ny", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, None, None), (5, "u", ""),
         (None, "n", "<p>one</p>"), (None, "n2", "é" * 50_000), (7, "c", "WARC/1.1\r\n\r\nWARC-Type: x\n")]


def pages(spark):
    return spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, `row` int, digest string").repartition(3)


def test_archive_round_trip(spark):
    out = warc.archived_pages(pages(spark)).collect()
    assert all(r.intact for r in out)
    assert Counter((r.page_id, r.payload) for r in out) == Counter((p, h or "") for p, _, h in PAGES)
    for r in out:
        digest = base64.b32encode(hashlib.sha1(r.payload.encode()).digest()).decode()
        assert r.payload_digest == digest and r.payload_bytes == len(r.payload.encode())
        assert r.header.startswith("WARC/1.1\r\n") and f"WARC-Payload-Digest: sha1:{digest}" in r.header
        assert "\r\n\r\n" not in r.header
    one = [r for r in out if r.payload == "<p>one</p>"]
    assert Counter(r.record_type for r in one) == {"response": 1, "revisit": 3}
    assert [r.page_id for r in one if r.record_type == "response"] == [1] and all(r.refers_to == 1 for r in one if r.record_type == "revisit")
    empty = {r.page_id: (r.record_type, r.refers_to) for r in out if r.payload == ""}
    assert empty == {2: ("response", None), 5: ("revisit", 2)}
    assert len({r.record_id for r in out}) == len(PAGES)


def test_payloads_are_stored_once(spark):
    path = scratch(spark, "test-warc")
    warc.write_archive(pages(spark), path, min_revisit_bytes=5)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    types = Counter(r.record_type for r in warc.read_archive(spark, path).collect())
    assert types == {"revisit": 3, "response": len(PAGES) - 3}


def test_empty_archive(spark):
    assert warc.archived_pages(pages(spark).limit(0)).count() == 0


def read_warc(path):
    """A plain reader of WARC files, by Content-Length."""
    for name in glob(f"{path}/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.startswith(b"Content-Length")))
            yield head.decode(), rest[:n].decode()
            assert rest[n:n + 4] == b"\r\n\r\n"
            data = rest[n + 4:]


def test_exported_files_are_warc(spark):
    records = warc.archived_pages(spark.read.parquet(f"{tiny()}/pages.parquet").unionByName(pages(spark).select("page_id", "url", "html")))
    path = scratch(spark, "test-export")
    warc.export_warc(records, path)
    want = Counter((r.header, "" if r.record_type == "revisit" else r.payload) for r in records.collect())
    assert Counter(read_warc(path.removeprefix("file:"))) == want


@pytest.mark.parametrize("text", ["", "a", "abc" * 99])
def test_base32(spark, text):
    from pyspark.sql import functions as F

    got = spark.range(1).select(warc.base32_sha1(F.lit(text)).alias("d")).first().d
    assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
