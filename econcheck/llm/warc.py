"""WARC archives: records written by Spark's text sink, and read back by boundary-chain verification.

Reading does not trust the magic ``WARC/1.``: a payload may hold it. Every place where a
well-formed header starts is a candidate that names its successor (the offset right behind
its block). Pointer jumping over those (file, offset) pairs, from offset 0 of each file,
doubles the reach in every round; what is never reached lies inside a payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from econcheck.llm import core
from econcheck.llm.store import written

#: fixed values of the format
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column (32 characters, no padding)."""
    return base32(F.sha1(data))


def base32(hexes: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits."""

    def five(h: Column, i: int) -> Column:
        bits = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        return F.get(F.transform(F.array(bits), lambda b: F.concat(*[F.substring(F.lit(BASE32), F.shiftright(b, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])), F.lit(0))

    # bound as a lambda's variable, the digest is worked out once
    return F.get(F.transform(F.array(hexes), lambda h: F.concat(*[five(h, i) for i in range(8)])), F.lit(0))


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", page.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """Write one record per row of ``pages(page_id, url, html)`` to gzipped archives under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest
    page_id becomes a response, the others revisits that name it and carry no payload. Rows
    equal in page_id and payload get the same kind. Null html is an empty payload; a null
    page_id is written as an empty field and is never the response of a group that has ids.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    keys = rows.select("page_id", "digest", "size").where(F.col("size") >= min_bytes)
    groups = keys.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = keys.join(groups, ["digest", "size"]).where("not (page_id <=> first)").select("page_id", "digest", "first").distinct()
    both = rows.join(copies, rows.page_id.eqNullSafe(copies.page_id) & (rows.digest == copies.digest), "left").select(rows["*"], "first").withColumn("digest", base32(F.col("digest")))
    again = F.col("first").isNotNull()
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("first"), F.col("digest")), F.lit("\r\nX-Refers-To-Page: "), F.col("first").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    block = F.when(again, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("html")))
    record = F.concat(head, F.octet_length(block).cast("string"), F.lit(RECORD_END), block)
    both.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


MAGIC = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def _unpacked(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def _candidates(files: DataFrame, payload: bool) -> DataFrame:
    fields = [("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("sound", pa.bool_())]
    schema = pa.schema([*fields, *([("payload", pa.binary())] if payload else [])])

    def number(x: bytes | None) -> int | None:
        return int(x) if x and x.strip().isdigit() or x and re.fullmatch(rb"-\d+", x) else None

    def rows(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _unpacked(content.as_py())
                for m in MAGIC.finditer(data):
                    head = {k.lower(): v for k, v in FIELD.findall(m[1])}
                    length = number(head.get(b"content-length"))
                    if length is None or length < 0:
                        continue
                    block = data[m.end() : m.end() + length]
                    body = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    kind, told = head.get(b"warc-type", b"").decode(), head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                    own = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind != "revisit" else told
                    size = len(body) if kind != "revisit" else number(head.get(b"x-payload-length"))
                    row = [file, m.start(), m.end() + length + 4, kind, head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), number(head.get(b"x-page-id")), number(head.get(b"x-refers-to-page")), size, own, own == told and len(block) == length]
                    yield [*row, body] if payload else row

    kind = "file string, at long, next long, kind string, uri string, page_id long, refers_to long, size long, digest string, sound boolean" + (", payload binary" if payload else "")
    return files.select("path", "content").mapInArrow(lambda b: core.batches(rows(b), schema, 256), kind)


def _reached(steps: DataFrame) -> DataFrame:
    """The (file, at) of ``steps(file, at, next)`` that the chain from offset 0 of their file visits."""
    step = written(steps)
    at = written(step.where("at = 0").select("file", "at"))
    jump = step
    while True:
        reach = at.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")).join(step.select("file", "at"), ["file", "at"], "left_semi")
        grown = written(at.union(reach).distinct())
        further = jump.select("file", "at", F.col("next").alias("mid")).join(jump.select("file", F.col("at").alias("mid"), "next"), ["file", "mid"]).select("file", "at", "next")
        jump, at = written(further), grown
        if jump.isEmpty():
            return at


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``: file, at, kind, uri, page_id, refers_to, size, digest, sound[, payload].

    One archive is unpacked in one task (the writer bounds its records; crawl archives are
    about a gigabyte by convention). ``sound`` says whether the payload has the digest of its
    header. A file without a record at offset 0 gives no rows; a chain ends where no
    well-formed header follows.
    """
    files = spark.read.format("binaryFile").load(path)
    light = written(_candidates(files, False))
    reached = _reached(light.select("file", "at", "next"))
    found = _candidates(files, True) if payload else light
    return found.join(reached, ["file", "at"], "left_semi").drop("next")
