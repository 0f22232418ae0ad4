"""WARC writer and reader: round trip, same bytes again, rolling, revisits, damaged files."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import warc

BIG = "<p>a page of more than one hundred bytes that occurs several times in the table of pages, as it is</p>" * 3
ROWS = [(1, "http://a/", BIG), (2, None, None), (3, "http://c/ü x\r\nEvil: 1", ""), (4, "http://d/", BIG), (5, "http://e/", "short"), (6, "http://f/", "short"),
        (None, "http://g/", BIG), (None, "http://h/", "no id, " * 30), (None, None, "no id, " * 30), (7, "http://i/", "é" * 300_000), (4, "http://d/", BIG), (-3, "http://j/", "x\r\n\r\ny" * 40)]


def pages(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, size int, digest string")


def test_round_trip_and_contract(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    both = pages(spark).select("page_id", "url", "html").union(spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id") + 100, "url", "html"))
    m = warc.write_warc(both, root, shard_bytes=20_000, file_bytes=9_000)
    got = warc.read_warc(m, root).collect()
    data = [(r.page_id, (r.html or "").encode()) for r in both.collect()]
    first = {}
    for i, p in data:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    want = []
    for i, p in data:
        to = first.get(p)
        again = len(p) >= 100 and to is not None and (i is None or i > to)
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", to if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted(p for (_, p), w in zip(data, want, strict=True) if w[3] == "response")
    listed = m.orderBy("shard", "seq").collect()
    assert len({r.shard for r in listed}) > 3 and sum(r.seq > 0 for r in listed) > 3
    assert all(os.path.getsize(tmp_path / "w" / r.name) == r.bytes for r in listed) and not [f for f in os.listdir(tmp_path / "w") if f.endswith(".tmp")]
    other = f"file://{tmp_path}/v"
    again = warc.write_warc(both.repartition(5), other, shard_bytes=20_000, file_bytes=9_000).orderBy("shard", "seq").collect()
    assert [(r.name, r.sha256) for r in again] == [(r.name, r.sha256) for r in listed]
    ids = [r.page_id for r in warc.read_warc(m.filter("shard = 1"), root).collect() if r.page_id is not None]
    assert ids == sorted(ids)


def test_empty_table(spark, tmp_path):
    assert warc.read_warc(warc.write_warc(pages(spark).limit(0), f"file://{tmp_path}/w"), f"file://{tmp_path}/w").count() == 0


def test_a_damaged_file_fails_the_read(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    m = warc.write_warc(pages(spark).filter("page_id = 1"), root)
    path = tmp_path / "w" / m.first().name
    whole = path.read_bytes()
    path.write_bytes(whole[:-20])
    with pytest.raises(Exception, match="ends within|Error"):
        warc.read_warc(m, root).collect()
    text = zlib.decompress(whole, 31).replace(b"several", b"seveval")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    path.write_bytes(z.compress(text) + z.flush())
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(m, root).collect()
