"""Deterministic sharded writer and reader of web archives (WARC 1.1, one gzip member a record).

Records are range-sorted by page id into shards of about as many bytes each, whose bounds
depend on the data alone (ids picked by a hash, with the bytes of their rows). Each shard is
one task and rolls to a new file when the next record would bring it over ``roll_bytes`` of
compressed bytes; a task streams its rows and holds one file, so shards may grow beyond
``shard_bytes`` where there would be more than ``MOST_SHARDS`` of them. A file is written under a temporary name and then
renamed; its manifest row follows. A task that runs again writes the same bytes under the
same name, so lost executors and repeated tasks leave no other result. Readers go by the
manifest and never see files that no manifest lists.

Equal payloads are kept once: the record with the smallest page id is a response, the
others are revisits that refer to it, with the payload's length and digest in their headers.

Defined results: null html is an empty payload; a null url becomes urn:page:<id>; a null
page id sorts first, never is the smallest id, and is a response only if its payload has no
row with an id; rows that repeat the smallest id of a payload are all responses; an empty
table gives an empty manifest. ``path`` has to be a folder that pyarrow's file systems open
on every executor (a mounted path, s3://, gs://, hdfs:// with libhdfs).
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveplan.llm.store import Run, read

SHARD_BYTES = 16 << 20
MOST_SHARDS = 1 << 16
SAMPLE_IDS = 1 << 17
ROLL_BYTES = 4 << 20
#: Bytes that a record's headers count for beside its payload.
_HEAD_BYTES = 512
DATE = "2024-01-01T00:00:00Z"
_READ = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard long, records long, bytes long, sha256 string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, sha: str) -> str:
    name = hashlib.sha1(f"{page_id}:{sha}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def _uri(url: str | None, page_id: int | None) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One compressed record; a revisit carries the HTTP header without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, sha)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is None:
        block += payload
    else:
        head += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, sha)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
    head.append(("Content-Type", "application/http; msgtype=response"))
    return _member(head, block)


class _File:
    """The file being filled; it is held in memory up to the roll size, then written at once."""

    def __init__(self, path: str, shard: int, part: int):
        self.path, self.shard, self.name = path, shard, f"part-{shard:06d}-{part:06d}.warc.gz"
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name)), ("WARC-Date", DATE)]
        info += [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        self.members = [_member(info, b"format: WARC File Format 1.1\r\n")]
        self.size = len(self.members[0])

    def add(self, member: bytes) -> None:
        self.members.append(member)
        self.size += len(member)

    def commit(self) -> dict:
        system, base = fs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        body = b"".join(self.members)
        temporary = f"{base}/.{self.name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary, compression=None) as out:
            out.write(body)
        system.move(temporary, f"{base}/{self.name}")
        return {
            "file": self.name,
            "shard": self.shard,
            "records": len(self.members) - 1,
            "bytes": len(body),
            "sha256": hashlib.sha256(body).hexdigest(),
        }


def _writer(path: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
        out = lambda row: pa.RecordBatch.from_pylist([row], schema=kinds)
        open_file, part, page, firsts = None, 0, None, {}
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("shard", "page_id", "tag", "url", "html", "sha", "first"))
            for shard, page_id, tag, url, html, sha, first in zip(*columns):
                if (shard, page_id) != page:
                    page, firsts = (shard, page_id), {}
                if tag == 0:
                    firsts[sha] = first
                    continue
                payload = (html or "").encode()
                sha1 = hashlib.sha1(payload)
                name = base64.b32encode(sha1.digest()).decode()
                member = record(page_id, url, payload, name, firsts.get(sha1.hexdigest()))
                if open_file and (open_file.shard != shard or open_file.size + len(member) > roll_bytes):
                    part = part + 1 if open_file.shard == shard else 0
                    yield out(open_file.commit())
                    open_file = None
                if open_file is None:
                    open_file = _File(path, shard, part)
                open_file.add(member)
        if open_file:
            yield out(open_file.commit())

    return write


def _bounds(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Ids at which a new shard begins, from ids picked by a hash: the same for the same rows."""
    row = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    shards = min(MOST_SHARDS, max(1, -(-int(row["b"] or 0) // shard_bytes)))
    if shards == 1:
        return []
    every = max(1, row["n"] // SAMPLE_IDS)
    picked = pages.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0))
    weight = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + _HEAD_BYTES).alias("b")
    found = sorted((r["page_id"], r["b"]) for r in picked.groupBy("page_id").agg(weight).collect())
    if not found:
        return []
    ids, size = (np.array(x, np.int64) for x in zip(*found))
    before = np.cumsum(size) - size
    edges = int(size.sum()) * np.arange(1, shards) // shards
    return np.unique(ids[np.minimum(np.searchsorted(before, edges), len(ids) - 1)]).tolist()


def _shard(bounds: list[int]) -> Column:
    """How many bounds are at or below the id."""
    if not bounds:
        return F.lit(0).cast("long")
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def at(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(edges, ids.fillna(0).astype("int64"), "right")))

    return at("page_id")


def write_archive(
    pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Write page_id, url and html of every row under ``path``; the manifest is a table there."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    names = rows.select("page_id", sha.alias("sha"))
    firsts = names.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1 AND first IS NOT NULL").select("sha", "first")
    later = names.join(firsts, "sha").filter("page_id IS NULL OR page_id > first").distinct()
    bounds = _bounds(rows, shard_bytes)
    shard, none = _shard(bounds), lambda kind: F.lit(None).cast(kind)
    stream = rows.select(
        shard.alias("shard"), "page_id", F.lit(1).alias("tag"), "url", "html", none("string").alias("sha"), none("long").alias("first")
    ).unionByName(
        later.select(
            shard.alias("shard"), "page_id", F.lit(0).alias("tag"), none("string").alias("url"), none("string").alias("html"), "sha", "first"
        )
    )
    dealt = stream.repartitionById(len(bounds) + 1, F.col("shard").cast("int"))
    dealt = dealt.sortWithinPartitions("shard", "page_id", "tag", "url", "html")
    manifest = dealt.mapInArrow(_writer(path, roll_bytes), MANIFEST)
    manifest.write.parquet(f"{path}/manifest.parquet")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest.parquet")


def parse(body: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive file."""
    view, at = memoryview(body), 0
    while at < len(body):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(body):
                raise ValueError("an archive file ends inside a record")
            parts.append(member.decompress(view[at : at + _READ]))
            at += _READ
        at = min(at, len(body)) - len(member.unused_data)
        plain = b"".join(parts)
        head, _, rest = plain.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        yield fields, block


def _reader(path: str, payloads: bool):
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name, sha256 in zip(batch["file"].to_pylist(), batch["sha256"].to_pylist()):
                system, base = fs.FileSystem.from_uri(path)
                with system.open_input_stream(posixpath.join(base, name), compression=None) as file:
                    body = file.read()
                if hashlib.sha256(body).hexdigest() != sha256:
                    raise ValueError(f"{name} differs from its manifest")
                rows = []
                for fields, block in parse(body):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if response and digest(payload) != sha:
                        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                    rows.append(
                        {
                            "page_id": number(fields.get("X-Page-ID")),
                            "url": fields["WARC-Target-URI"],
                            "payload_bytes": len(payload) if response else int(http["Content-Length"]),
                            "payload_digest": sha,
                            "record_type": fields["WARC-Type"],
                            "refers_to": number(fields.get("X-Refers-To-Page-ID")),
                            "payload": payload if payloads and response else None,
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return load


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record that the manifest under ``path`` lists, its digests checked."""
    kinds = spark.createDataFrame([], MANIFEST).schema
    manifest = spark.read.schema(kinds).parquet(f"{path}/manifest.parquet")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "sha256").repartition(wide, "file").mapInArrow(_reader(path, payloads), _RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Run(spark, 'warc').path}/archive"
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first FROM p GROUP BY h
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
