"""Deterministic sharded WARC writer and its reader.

Pages are dealt to shards by ranges of page_id of about equal size, sorted, and written as gzip members, a new file
whenever the current one has reached its compressed size. Headers and digests are made from the page alone, so a
task that runs again writes the same bytes to the same name; a file appears under its name by a rename, and only
files in the manifest, which Spark commits last, belong to the archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, shared_folder
from tidemark.session import running_totals

DATE = "2020-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MAX_SHARDS = 100_000  # bounds the table of shard limits that every task holds


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes | None, digest: str, size: int, date: str, refers_to: int | None = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit (payload None) with the response's HTTP header."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or f'urn:page:{page_id}', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Roller:
    """Writes the members of one shard to files of about `limit` bytes under temporary names."""

    def __init__(self, root: str, shard: int, limit: int):
        self.files, self.path = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.seq, self.out, self.done = shard, limit, 0, None, []

    def write(self, member: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.path}/.{self.shard:06d}-{self.seq:04d}-{uuid.uuid4().hex}.tmp"
            self.out, self.sha, self.bytes, self.records = self.files.open_output_stream(self.temp), hashlib.sha256(), 0, 0
        self.out.write(member)
        self.sha.update(member)
        self.bytes, self.records = self.bytes + len(member), self.records + 1
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"
            self.files.move(self.temp, f"{self.path}/{name}")
            self.done.append({"shard": self.shard, "seq": self.seq, "name": name, "bytes": self.bytes, "records": self.records, "sha256": self.sha.hexdigest()})
            self.seq, self.out = self.seq + 1, None


def _limits(light: DataFrame, shard_bytes: int) -> np.ndarray:
    """Smallest page_id of every shard; shards hold about `shard_bytes` of payload and grow beyond MAX_SHARDS."""
    known = light.filter("page_id is not null")
    total = known.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    size = max(shard_bytes, -(-total // MAX_SHARDS), 1)
    placed = running_totals(known.select("page_id", "digest", "size"), ["page_id", "digest", "size"], {"upto": F.col("size")})
    first = placed.groupBy(F.floor((F.col("upto") - F.col("size")) / size).alias("s")).agg(F.min("page_id").alias("lo"))
    return np.unique(first.toPandas()["lo"].to_numpy(dtype=np.int64))


def write_warc(
    pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = 100, shard_bytes: int = 4 << 20, file_bytes: int = 1 << 20, date: str = DATE,
) -> DataFrame:
    """Write an archive below the URI `root`, a new folder that all executors reach, and return its manifest.

    Of pages with equal payloads of `least` bytes or more, that with the smallest id is a response and the others
    are revisits of it; smaller payloads are always responses. A null html is an empty payload and a null url gets a
    name by the page's id. Rows that repeat an id and a payload get the same kind of record each. Pages without an
    id are spread over the shards, come last there, and are revisits only of a page with an id, else responses.
    An empty table gives an empty manifest. Payloads are compressed one at a time, whole.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    wide = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    light = saved(wide.select("page_id", "digest", "size"), "pages")
    limits = pages.sparkSession.sparkContext.broadcast(_limits(light, shard_bytes))
    n = max(1, len(limits.value))
    first = light.filter(f"size >= {least}").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).filter("k > 1 and refers_to is not null")
    again = light.join(first, "digest").filter(f"size >= {least} and (page_id is null or page_id > refers_to)").select("page_id", "digest", "refers_to").distinct()

    def shard(batches):
        for b in batches:
            ids, digests, out = b["page_id"].to_pylist(), b["digest"].to_pylist(), []
            for i, d in zip(ids, digests, strict=True):
                out.append(int(d[:8], 16) % n if i is None else int(np.searchsorted(limits.value, i, side="right")) - 1)
            yield b, ids, digests, out

    fields = [("shard", pa.int32()), ("page_id", pa.int64()), ("digest", pa.string()), ("kind", pa.int32()), ("refers_to", pa.int64()),
              ("url", pa.string()), ("size", pa.int64()), ("member", pa.binary())]
    schema, kind = pa.schema(fields), "shard int, page_id long, digest string, kind int, refers_to long, url string, size long, member binary"

    def marks(batches):
        for b, ids, digests, own in shard(batches):
            k = len(ids)
            yield pa.RecordBatch.from_pydict({"shard": own, "page_id": ids, "digest": digests, "kind": [0] * k, "refers_to": b["refers_to"],
                                              "url": [None] * k, "size": [None] * k, "member": [None] * k}, schema)

    def members(batches):
        for b, ids, digests, own in shard(batches):
            urls, sizes, k = b["url"].to_pylist(), b["size"].to_pylist(), len(ids)
            data = [record(i, u, p.as_py(), d, s, date) for i, u, p, d, s in zip(ids, urls, b["payload"], digests, sizes, strict=True)]
            yield pa.RecordBatch.from_pydict({"shard": own, "page_id": ids, "digest": digests, "kind": [1] * k, "refers_to": [None] * k,
                                              "url": urls, "size": sizes, "member": data}, schema)

    def write(batches):
        roller, mark = None, {}
        for b in batches:
            for r in b.to_pylist():
                if roller is None or roller.shard != r["shard"]:
                    if roller is not None:
                        roller.close()
                        yield from manifest(roller)
                    roller, mark = _Roller(root, r["shard"], file_bytes), {}
                if r["kind"] == 0:
                    # Marks of an id come just before its pages; pages without an id are told by their payload.
                    mark = {**(mark if mark and next(iter(mark))[0] == r["page_id"] else {}), (r["page_id"], r["digest"]): r["refers_to"]}
                    continue
                to = mark.get((r["page_id"], r["digest"]))
                roller.write(r["member"] if to is None else record(r["page_id"], r["url"], None, r["digest"], r["size"], date, to))
        if roller is not None:
            roller.close()
            yield from manifest(roller)

    listed = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])

    def manifest(roller: _Roller) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist(roller.done, listed)

    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    rows = wide.mapInArrow(members, kind).union(again.mapInArrow(marks, kind))
    # Nulls last in a shard; by kind before digest, so that marks of an id are all read before its pages.
    dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "digest", "url")
    return saved(dealt.mapInArrow(write, "shard int, seq int, name string, bytes long, records long, sha256 string"), "manifest")


def read_members(data) -> Iterator[bytes]:
    """Whole gzip members of a stream, one at a time."""
    z, out = zlib.decompressobj(31), []
    while chunk := data.read(1 << 16):
        while chunk:
            out.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
    if any(out) or z.unconsumed_tail:
        raise ValueError("the archive ends within a record")


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of every
    record of the archive's files; a file or payload that does not match its digest fails the read."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def parse(member: bytes) -> dict:
        head, block = member[:-4].split(b"\r\n\r\n", 1)
        h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        http, payload = block.split(b"\r\n\r\n", 1)
        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
        if hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest of {h['WARC-Record-ID']}")
        response = h["WARC-Type"] == "response"
        if response and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
        size = len(payload) if response else int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        num = lambda k: int(h[k]) if k in h else None
        return {"page_id": num("X-Page-Id"), "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
                "record_type": h["WARC-Type"], "refers_to": num("X-Refers-To-Page-Id"), "payload": payload if response else None}

    def part(batches):
        files, path = fs.FileSystem.from_uri(root)
        for b in batches:
            for r in b.to_pylist():
                rows, held, n = [], 0, 0
                with files.open_input_stream(f"{path}/{r['name']}", compression=None) as data:
                    for m in read_members(data):
                        rows.append(parse(m))
                        held, n = held + len(m), n + 1
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if n != r["records"]:
                    raise ValueError(f"{r['name']}: {n} of {r['records']} records")
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = manifest.repartition(F.xxhash64("name"))
    return spread.mapInArrow(part, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op2_query(pages: DataFrame) -> DataFrame:
    path = shared_folder(pages.sparkSession, "warc")
    root = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return read_warc(write_warc(pages, root), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
