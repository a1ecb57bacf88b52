"""WARC archives with a two-level capture index.

Archives hold one gzip member per record.  The index holds captures sorted by
reversed-host URL key: compressed blocks of lines, and behind them a sparse
directory with the first key of each block.  A lookup bisects the directory,
reads one block range after the other, bisects the lines, and then range-reads
the records.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_dir, session, shuffle_partitions, table, written

DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOOTER = "<QQ"


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode().rstrip("=")


def url_key(url: F.Column) -> F.Column:
    """Sort-friendly key ``com,example,www)/path?query``; null gives ``)``."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with the WARC record of a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def _headers(text: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in text.decode().split("\r\n")[1:] if ":" in line)}


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn[10:-1] else None


def parse(member: bytes) -> dict:
    """Read a record back; the digest of a response is taken from its payload."""
    raw = gzip.decompress(member)
    end = raw.index(b"\r\n\r\n")
    head = _headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    payload = block[http_end + 4 :]
    kind = head["warc-type"]
    stated = head["warc-payload-digest"].removeprefix("sha1:")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else stated
    size = int(_headers(block[:http_end])["content-length"])
    if digest != stated or kind == "response" and len(payload) != size:
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return {
        "id": _page(head["warc-record-id"]),
        "url": head["warc-target-uri"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows ``(id, url, payload, digest, first)``: ``first`` is the smallest id
    among equal payloads of at least ``min_bytes`` bytes, else the row's own.

    The digests are combined before the shuffle; a payload that a large share
    of the rows has makes one skewed join key, which adaptive execution splits.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"),
    )
    key = [F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")]
    firsts = rows.select("id", *key).groupBy("digest", "size").agg(F.min("id").alias("first"))
    return rows.select("*", *key).join(firsts, ["digest", "size"]).select(
        "id", "url", "payload", "digest", F.when(F.col("size") >= min_bytes, F.col("first")).otherwise(F.col("id")).alias("first")
    )


def write_archives(planned: DataFrame, folder: str, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write archives below ``folder``; return the captures as a written table.

    A task writes files under names of its own attempt and reports captures
    only when it ends well, so repeated attempts leave unused files at worst.
    """
    session(planned)
    rows = planned.withColumn("surt", url_key(F.col("url")))
    schema = "surt string, id long, file string, offset long, length long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        for b in batches:
            got = []
            for r in b.to_pylist():
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, at = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                kind = "response" if r["id"] == r["first"] else "revisit"
                data = record(r["id"], r["url"], r["payload"], kind, base32_digest(r["digest"]), r["first"])
                out.write(data)
                got.append({"surt": r["surt"], "id": r["id"], "file": name, "offset": at, "length": len(data)})
                at += len(data)
            if got:
                yield pa.RecordBatch.from_pylist(got, pa.schema([("surt", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return written(rows.mapInArrow(write, schema), "captures")


def build_index(captures: DataFrame, folder: str, lines_per_block: int = 2000) -> DataFrame:
    """Sort captures into index shards below ``folder``; one row per shard.

    The range partitioning includes the id, so captures of one URL, however
    many, spread over shards.  A shard is streamed: blocks, directory, footer.
    """
    rows = captures.repartitionByRange(shuffle_partitions(captures.sparkSession), "surt", "id").sortWithinPartitions("surt", "id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        out, at, lines, directory, last = None, 0, [], [], ""

        def flush() -> None:
            nonlocal at, lines, last
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], at, len(block)])
            last = lines[-1][0]
            out.write(block)
            at += len(block)
            lines = []

        for b in batches:
            for r in b.to_pylist():
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append([r["surt"], r["id"], r["file"], r["offset"], r["length"]])
                if len(lines) == lines_per_block:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = zlib.compress(json.dumps(directory).encode())
        out.write(tail + struct.pack(FOOTER, at, len(tail)))
        out.close()
        yield pa.RecordBatch.from_pylist([{"shard": name, "first": directory[0][0], "last": last}])

    return written(rows.mapInArrow(write, "shard string, first string, last string"), "shards")


def lookup(shards: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """Captures ``(surt, id, file, offset, length)`` of the wanted ``keys.surt``.

    The driver holds one row per shard (as many as index partitions), never
    keys or captures.  Repeated and null keys count once and not at all.
    """
    bounds = sorted((r["first"], r["last"], r["shard"]) for r in shards.collect())
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]
    wanted = keys.select("surt").where("surt IS NOT NULL").distinct()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for key in b.column(0).to_pylist():
                got += [(bounds[k][2], key) for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in (0, 1)], ["shard", "surt"])

    def search(group: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(folder)
        got, held, lines = [], None, []
        with fs.open_input_file(f"{root}/{group.column('shard')[0].as_py()}") as f:
            tail = struct.calcsize(FOOTER)
            at, size = struct.unpack(FOOTER, f.read_at(tail, f.size() - tail))
            directory = json.loads(zlib.decompress(f.read_at(size, at)))
            starts = [d[0] for d in directory]
            for key in sorted(group.column("surt").to_pylist()):
                for k in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key)):
                    if k != held:
                        held, lines = k, [json.loads(x) for x in zlib.decompress(f.read_at(directory[k][2], directory[k][1])).decode().split("\n")]
                    lo = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    hi = bisect.bisect_right(lines, key, key=lambda x: x[0])
                    got += lines[lo:hi]
        kinds = (("surt", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
        return pa.table({n: pa.array([g[k] for g in got], t) for k, (n, t) in enumerate(kinds)})

    return (
        wanted.mapInArrow(deal, "shard string, surt string")
        .groupBy("shard")
        .applyInArrow(search, "surt string, id long, file string, offset long, length long")
    )


def fetch(found: DataFrame, folder: str, with_payload: bool = True, stretch: int = 8 << 20) -> DataFrame:
    """Range-read the captured records and parse them, a row each.

    Captures are dealt by stretches of an archive, so that one archive, or one
    URL with very many captures, is read by many tasks in file order.
    """
    session(found)
    fields = [
        ("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
    rows = (
        found.select("file", "offset", "length", F.expr(f"offset DIV {stretch}").alias("stretch"))
        .repartition(shuffle_partitions(found.sparkSession), "file", "stretch")
        .sortWithinPartitions("file", "offset")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, f = None, None
        for b in batches:
            got = []
            for r in b.to_pylist():
                if r["file"] != name:
                    name = r["file"]
                    f = fs.open_input_file(f"{root}/{name}")
                page = parse(f.read_at(r["length"], r["offset"]))
                if not with_payload:
                    page["payload"] = None
                got.append(page)
            yield pa.RecordBatch.from_pylist(got, pa.schema(fields))

    return rows.mapInArrow(
        read,
        "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0, with_payload: bool = True, **columns: str) -> DataFrame:
    """Archive ``pages``, index the captures, look every URL up and read it back.

    One row per row of ``pages``.  Of records with equal payloads the smallest
    id is the response (each of its rows, should the id repeat), the others
    are revisits of it; a null payload is empty, a null URL has the key ``)``.
    A null id is a revisit of the smallest id among equal payloads, or of none.
    An empty table gives no rows; other columns are not read.
    """
    spark = session(pages)
    folder = fresh_dir(spark, "warc")
    captures = write_archives(plan_records(pages, min_bytes=min_bytes, **columns), f"{folder}/archives")
    shards = build_index(captures, f"{folder}/index")
    wanted = pages.select(url_key(F.col(columns.get("url_col", "url"))).alias("surt"))
    return fetch(lookup(shards, f"{folder}/index", wanted), f"{folder}/archives", with_payload)


def op2_warc_archive(spark, sf_dir: str) -> DataFrame:
    read = archive_pages(table(spark, sf_dir, "pages"), with_payload=False)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_QUADS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {s}) & 31)::INT, 1)" for s in (15, 10, 5, 0)
)
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
     e AS (SELECT x, min(page_id) AS lead FROM d GROUP BY x),
     b AS (SELECT x, lead, array_to_string(list_transform(list_transform(range(0, 8), lambda g:
             ('0x' || substr(x, (5 * g + 1)::INT, 5))::BIGINT), lambda v: {_QUADS}), '') AS payload_digest FROM e)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM d JOIN b USING (x)
"""
